"""Graph description files: a header, node lines, EDGES, edge lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import near_parts
from ..operators.network import Network
from .scratch import Scratch

# Fixed format: "name 0|1", then "id type rank [json]" lines, a line EDGES, then "u v [json]" lines.
EDGES = "EDGES"
_ATTRIBUTES = "map<string,string>"


def _tokens() -> Column:
    """The words of a line, and as the last token the object that begins at its first brace, if there is one.

    The object is the rest of the line, so it may nest and hold braces in strings; what does not end in a brace is no object
    and makes one word too many.
    """
    at = F.instr("line", "{")
    words = F.when(at > 0, F.substring("line", F.lit(1), at - 1)).otherwise(F.col("line"))
    words = F.filter(F.split(words, r"\s+"), lambda w: w != "")
    rest = F.substring("line", at, F.length("line"))
    return F.when(at == 0, words).when(rest.endswith("}"), F.concat(words, F.array(rest))).otherwise(F.concat(words, F.array(rest, F.lit(""))))


def _checked(section: Column, good: Column, value: Column, message: str) -> Column:
    """value, or an error for a malformed line of the section. The section is part of the expression: filters on the value
    that Spark derives from later joins may run before the lines of other sections are left out."""
    error = F.raise_error(F.concat(F.lit(message), F.col("line"))).cast("string")
    return F.when(section & good, value).when(section, error)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, nodes, edges) of lines (line_no, line): name and directed; id, type, rank, attrs; u, v, attrs.

    A malformed line is an error when its row is computed.
    """
    lines = lines.withColumn("line", F.trim("line")).filter("line != ''")
    marks = lines.filter(F.col("line") == EDGES).agg(F.min("line_no").alias("mark"))
    first = lines.agg(F.min("line_no").alias("first"))
    # one row each
    placed = lines.join(F.broadcast(marks), how="cross").join(F.broadcast(first), how="cross").withColumn("t", _tokens())
    n, t = F.size("t"), F.col("t")
    ends_in_object = lambda k: F.get(t, F.lit(k)).startswith("{")

    in_header = F.col("line_no") == F.col("first")
    header = placed.filter(in_header).select(
        _checked(in_header, n == 2, t[0], "not a graph header: ").alias("name"),
        _checked(in_header, (n == 2) & F.get(t, F.lit(1)).rlike(r"^-?\d+$"), F.get(t, F.lit(1)), "not a graph header: ").cast("int").cast("boolean").alias("directed"),
    )
    node_ok = ((n == 3) | ((n == 4) & ends_in_object(3))) & ~ends_in_object(2)
    in_nodes = (F.col("line_no") > F.col("first")) & (F.col("mark").isNull() | (F.col("line_no") < F.col("mark")))
    nodes = placed.filter(in_nodes).select(
        _checked(in_nodes, node_ok, t[0], "not a node line: ").cast("long").alias("id"),
        F.get(t, F.lit(1)).cast("int").alias("type"),
        F.get(t, F.lit(2)).cast("int").alias("rank"),
        F.from_json(F.get(t, F.lit(3)), _ATTRIBUTES).alias("attrs"),
    )
    edge_ok = ((n == 2) | ((n == 3) & ends_in_object(2))) & ~ends_in_object(1)
    in_edges = F.coalesce(F.col("line_no") > F.col("mark"), F.lit(False))
    edges = placed.filter(in_edges).select(
        _checked(in_edges, edge_ok, t[0], "not an edge line: ").cast("long").alias("u"),
        F.get(t, F.lit(1)).cast("long").alias("v"),
        F.from_json(F.get(t, F.lit(2)), _ATTRIBUTES).alias("attrs"),
    )
    return header, nodes, edges


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, or of a folder's parts in order of name, read by as many tasks as there are splits.

    line_no orders lines as they stand in the file: by part, by the split that a line begins in, and within it as read.
    """
    place = F.struct(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_network(spark: SparkSession, path: str, create: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, Network]:
    """The name and network of a graph file; an edge to a node that is not listed is a ValueError.

    create makes the nodes' rows from (id, type, rank, attrs), as by columns taken from attrs; it keeps id.
    """
    lines = Scratch(spark, "graph-file").write(numbered_lines(spark, path), "lines")
    header, nodes, edges = parse_lines(lines)
    nodes = create(nodes) if create else nodes
    name, directed = header.first()
    edges = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "attrs")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if unknown := ends.join(nodes.select("id"), "id", "left_anti").head():
        raise ValueError(f"an edge names node {unknown.id}, which is not listed")
    return name, Network.create(nodes, edges, directed)


def network_lines(name: str, network: Network, ranks: DataFrame) -> DataFrame:
    """(section, a, b, line) of a graph file, to be ordered by the first three.

    ranks: (id, part) for every node. An attribute agent_type becomes the node's type (0 without it) and leaves the object.
    """
    spark = network.nodes.sparkSession
    has = lambda df: "attrs" in df.columns
    attrs = F.coalesce(F.col("attrs"), F.create_map().cast(_ATTRIBUTES)) if has(network.nodes) else F.create_map().cast(_ATTRIBUTES)
    named = F.element_at(attrs, "agent_type")
    own_type = F.col("type") if "type" in network.nodes.columns else F.lit(0)
    kind = F.coalesce(named.cast("int"), own_type)
    kind = F.when(kind < 0, F.raise_error(F.lit("an agent_type is 0 or more")).cast("int")).otherwise(kind)
    rest = F.map_filter(attrs, lambda k, _: k != "agent_type")
    tail = lambda m: F.when(F.size(m) > 0, F.concat(F.lit(" "), F.to_json(m))).otherwise("")
    nodes = network.nodes.join(ranks, "id").select(
        F.lit(1).alias("section"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.concat_ws(" ", "id", kind, "part"), tail(rest)).alias("line")
    )
    edge_attrs = F.coalesce(F.col("attrs"), F.create_map().cast(_ATTRIBUTES)) if has(network.edges) else F.create_map().cast(_ATTRIBUTES)
    edges = network.edges.select(F.lit(3).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.concat_ws(" ", "src", "dst"), tail(edge_attrs)).alias("line"))
    marks = spark.createDataFrame([(0, 0, 0, f"{name} {int(network.directed)}"), (2, 0, 0, EDGES)], "section int, a long, b long, line string")
    return marks.unionByName(nodes).unionByName(edges)


def write_network(name: str, network: Network, path: str, n_ranks: int, method: str = "random", seed: int | None = None, **partition_args) -> None:
    """Writes a graph file with nodes dealt to n_ranks, as parts in a folder that make up the file in order of name.

    Each part is a range of the lines, so that no task has them all. Methods are 'random', and 'near', which cuts few edges
    (graphs.near_parts, to which partition_args go).
    """
    if method == "random":
        parts = network.random_parts(n_ranks, seed)
    elif method == "near":
        parts = near_parts(network, n_ranks, Scratch(network.nodes.sparkSession, "parts").write, **partition_args)
    else:
        raise ValueError(f"no partition method {method!r}")
    lines = network_lines(name, network, parts)
    keys = ["section", "a", "b"]
    ordered = lines.repartitionByRange(network.parts, *keys).sortWithinPartitions(*keys) if network.parts else lines.orderBy(*keys)
    ordered.select("line").write.text(path)
