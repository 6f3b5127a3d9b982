"""Networks over agents: node and edge tables, directed or not."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .population import UID

ENDS = ["src", "dst"]
#: Rows, counted before, up to which a table is broadcast to the links.
FEW = 100_000
#: Rows that one task gets of a table dealt out by size.
PART_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that may not be broadcast, however small its files are: it grows with the nodes or edges."""
    return df.hint("merge")


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of PART_ROWS rows at most on average, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df dealt out by keys to so many tasks, which adaptive execution does not merge; without parts, df as it is."""
    return df.repartition(parts, *keys) if parts else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join, broadcast if its rows, counted before, are few."""
    return F.broadcast(df) if rows <= FEW else shuffled(df)


def _ordered(df: DataFrame, directed: bool) -> DataFrame:
    """Edges in canonical form: of an undirected edge, the smaller end first."""
    if directed:
        return df
    return df.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


@dataclass(frozen=True)
class Network:
    """nodes(id, ...) and edges(src, dst, attribute columns), one row for each edge.

    parts: where edges are dealt out by both ends to so many tasks, new ones are too, so that what a task holds is set by the
    number of edges and not by the session's number of partitions.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    parts: int | None = None

    @classmethod
    def create(cls, nodes: DataFrame, edges: DataFrame, directed: bool = False) -> Network:
        """Nodes that only edges name are added; edges are brought to canonical form, of repeated ones one stays."""
        edges = _ordered(edges, directed).dropDuplicates(ENDS)
        return cls(nodes, edges, directed)._with_ends(edges)

    def _with_ends(self, edges: DataFrame) -> Network:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        new = ends.join(shuffled(self.nodes.select("id")), "id", "left_anti")
        return replace(self, nodes=self.nodes.unionByName(new, allowMissingColumns=True), edges=edges)

    def with_ends(self) -> Network:
        """With the nodes that only edges name; for edges that are in canonical form and not repeated."""
        return self._with_ends(self.edges)

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ENDS]

    def add_nodes(self, nodes: DataFrame) -> Network:
        new = nodes.dropDuplicates(["id"]).join(self.nodes.select("id"), "id", "left_anti")
        return replace(self, nodes=self.nodes.unionByName(new, allowMissingColumns=True))

    def _uid(self, agents: DataFrame) -> list[str]:
        """What names a node: its id, with type and uid_rank where nodes and agents have them."""
        return [c for c in UID if c in self.nodes.columns and c in agents.columns]

    def add(self, agents: DataFrame) -> Network:
        """Agents as nodes; those who are nodes already stay as they are. Columns that nodes lack are left out."""
        own = [c for c in self.nodes.columns if c in agents.columns]
        new = agents.select(*own).dropDuplicates(self._uid(agents)).join(self.nodes.select(*self._uid(agents)), self._uid(agents), "left_anti")
        return replace(self, nodes=self.nodes.unionByName(new, allowMissingColumns=True))

    def remove(self, agents: DataFrame) -> Network:
        """Without the nodes of the given agents and the edges that touch them."""
        return self.remove_nodes(self.nodes.join(agents.select(*self._uid(agents)), self._uid(agents), "left_semi").select("id"))

    def missing_nodes(self, ids: DataFrame) -> DataFrame:
        """Those of the given ids that are no nodes: what a strict removal has to refuse."""
        return ids.select("id").join(self.nodes.select("id"), "id", "left_anti")

    def remove_nodes(self, ids: DataFrame, strict: bool = False) -> Network:
        """Without the given nodes and the edges that touch them. Ids that are no nodes do nothing, or are a KeyError at
        once if strict."""
        gone = ids.select("id")
        if strict and (unknown := self.missing_nodes(gone).head()):
            raise KeyError(unknown.id)
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(gone, "id", "left_anti"), edges=edges.select(*self.edges.columns))

    def add_edges(self, new: DataFrame, order: str | None = None) -> Network:
        """Upsert: attributes of a new edge replace those there; nulls leave them. Of repeated ones the last by
        the column `order` counts, without it the greatest value of each attribute."""
        new = _ordered(new, self.directed)
        if order:
            last = [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in self.attributes if a in new.columns]
        else:
            last = [F.max(a).alias(a) for a in self.attributes if a in new.columns]
        new = dealt(new, self.parts, *ENDS).groupBy(*ENDS).agg(F.count("*").alias("_n"), *last).drop("_n")
        both = self.edges.join(new.select(*ENDS, *(F.col(a).alias(f"new_{a}") for a in new.columns if a not in ENDS)), ENDS, "full")
        merged = [F.coalesce(f"new_{a}", a).alias(a) if f"new_{a}" in both.columns else F.col(a) for a in self.attributes]
        return self._with_ends(both.select(*ENDS, *merged))

    def _refuse(self, edges: DataFrame) -> None:
        if unknown := self.missing_edges(edges).head():
            raise KeyError((unknown.src, unknown.dst))

    def update_edges(self, changes: DataFrame, strict: bool = False) -> Network:
        """Attributes of edges that are there replaced by those of changes. Changes for other edges do nothing, or are a
        KeyError at once if strict."""
        if strict:
            self._refuse(changes)
        changes = _ordered(changes, self.directed)
        named = [a for a in self.attributes if a in changes.columns]
        both = self.edges.join(changes.select(*ENDS, *(F.col(a).alias(f"new_{a}") for a in named)), ENDS, "left")
        return replace(self, edges=both.select(*ENDS, *(F.coalesce(f"new_{a}", a).alias(a) if a in named else F.col(a) for a in self.attributes)))

    def missing_edges(self, edges: DataFrame) -> DataFrame:
        """Those of the given edges that are not there: what a strict update or removal has to refuse."""
        return _ordered(edges, self.directed).join(self.edges.select(*ENDS), ENDS, "left_anti")

    def remove_edges(self, edges: DataFrame, strict: bool = False) -> Network:
        """Without the given edges; edges that are not there do nothing, or are a KeyError at once if strict."""
        if strict:
            self._refuse(edges)
        return replace(self, edges=self.edges.join(_ordered(edges, self.directed).select(*ENDS), ENDS, "left_anti"))

    def clear_edges(self) -> Network:
        return replace(self, edges=self.edges.limit(0))

    def contains_edges(self, edges: DataFrame) -> DataFrame:
        """The given edges with whether they are there, in either direction if undirected."""
        asked = edges.select(*ENDS).withColumns({"a": F.col("src"), "b": F.col("dst")})
        there = self.edges.select(*ENDS, F.lit(True).alias("found"))
        found = _ordered(asked, self.directed).join(there, ENDS, "left")
        return found.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce("found", F.lit(False)).alias("found"))

    def incident(self) -> DataFrame:
        """(id, other, outgoing) for each end of each edge; an undirected loop comes once."""
        forward = F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"))
        backward = F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("outgoing"))
        sides = F.array(forward, backward) if self.directed else F.when(F.col("src") == F.col("dst"), F.array(forward)).otherwise(F.array(forward, backward))
        return self.edges.select(F.explode(sides).alias("e"), *self.attributes).select("e.*", *self.attributes)

    def degrees(self) -> DataFrame:
        """Edges at each node; a directed network counts those out and in."""
        counts = self.incident().groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def successors(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))

    def predecessors(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))

    def neighbours(self) -> DataFrame:
        """Nodes next to each node: successors if directed, either end's other if not."""
        return self.successors() if self.directed else self.incident().select("id", "other")

    def counts(self) -> DataFrame:
        n_nodes = self.nodes.agg(F.count("*").alias("node_count"))
        return n_nodes.join(self.edges.agg(F.count("*").alias("edge_count")), how="cross")  # one row each

    def reached(self, seeds: DataFrame, max_levels: int | None = None, keep=None) -> DataFrame:
        """(id, level) by breadth-first search along neighbours. keep: writes a level's table and returns it, to cut lineage."""
        keep = keep or (lambda df, name: df.checkpoint())
        links = self.neighbours().select(F.col("id").alias("from_id"), F.col("other").alias("id"))
        seen = keep(seeds.select("id").distinct().withColumn("level", F.lit(0)), "level0")
        front, level = seen, 0
        while (n := front.count()) and level != max_levels:
            level += 1
            new = links.join(few(front.select(F.col("id").alias("from_id")), n), "from_id").select("id").distinct()
            front = keep(new.join(shuffled(seen), "id", "left_anti").withColumn("level", F.lit(level)), f"level{level}")
            seen = seen.unionByName(front)
        return seen

    def random_parts(self, n: int, seed: int | None = None) -> DataFrame:
        """(id, part): nodes in an order drawn from (seed, id), dealt out in turn, so that sizes differ by one at most.

        Ranks come from counts by range of the drawn number, so no task sorts all nodes.
        """
        drawn = self.nodes.select("id", draw("id", 0, 0, seed).alias("d"))
        width = 1 << 16
        ranges = drawn.withColumn("slot", F.floor(F.col("d") / width))
        counts = ranges.groupBy("slot").agg(F.count("*").alias("size"))  # 32768 rows at most
        before = F.coalesce(F.sum("size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("slot", before.alias("before"))
        place = F.row_number().over(Window.partitionBy("slot").orderBy("d", "id")) - 1
        return ranges.join(F.broadcast(starts), "slot").select("id", ((F.col("before") + place) % n).cast("int").alias("part"))

    def cut(self, part: Column | str, nodes: DataFrame) -> DataFrame:
        """Edges whose ends lie in different parts, given nodes (id, part)."""
        a = nodes.select(F.col("id").alias("src"), F.col(part).alias("src_part"))
        b = nodes.select(F.col("id").alias("dst"), F.col(part).alias("dst_part"))
        return self.edges.select(*ENDS).join(a, "src").join(b, "dst").filter("src_part != dst_part")
