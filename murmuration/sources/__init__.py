"""Readers and writers: graph files, logs, checkpoints, parameters."""
