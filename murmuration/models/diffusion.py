"""Heat on a raster."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators.raster import ValueLayer


def run(layer: ValueLayer, steps: int, rate: float = 0.1, keep: Callable[[DataFrame, str], DataFrame] | None = None, every: int = 5, digits: int | None = None) -> ValueLayer:
    """The layer after `steps` of diffusion. keep writes the cells each `every` steps, to cut lineage."""
    for k in range(1, steps + 1):
        layer = layer.diffuse(rate, digits)
        if keep and k % every == 0:
            layer = replace(layer, cells=keep(layer.cells, f"diffusion{k}"))
    return layer
