"""Graphs as two DataFrames: vertices(id, [x, y]) and edges(src, dst, [w]), both directions stored if undirected.

Isolated vertices survive every operation and keep their ids; `reindex` makes dense ids where a format needs them.
Self-loops and repeated edges are dropped on construction unless `simple=False`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import dist, quantise, uniform
from ..runtime import cut_plan


def swapped(edges: DataFrame) -> DataFrame:
    """Every edge turned round; other columns stay."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


class Graph:
    def __init__(self, vertices: DataFrame, edges: DataFrame, directed: bool = False) -> None:
        self.vertices, self.edges, self.directed = vertices, edges, directed

    # construction

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False, dense: bool = False) -> Graph:
        """From (src, dst, [w]) rows: duplicates and self-loops go, the other direction is added unless directed.

        Vertices are those given, or the ends of all edges, or with `dense` every id from 0 to the largest.
        """
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        kept = edges.where("src <> dst")
        if not directed:
            kept = kept.select("src", "dst", *rest).unionByName(swapped(kept.select("src", "dst", *rest)))
        kept = kept.groupBy("src", "dst").agg(*(F.min(c).alias(c) for c in rest)) if rest else kept.select("src", "dst").distinct()
        if vertices is None:
            vertices = ends
            if dense:
                top = ends.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
                vertices = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("id"))
        return cls(vertices, kept, directed)

    @classmethod
    def from_adjacency(cls, lists: DataFrame, directed: bool = True) -> Graph:
        """From (id, neighbours array): neighbours once each; not made symmetric unless asked for."""
        edges = lists.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))
        return cls.from_edges(edges, lists.select("id").distinct(), directed)

    @classmethod
    def empty(cls, spark: SparkSession, n: int) -> Graph:
        return cls(spark.range(n), spark.createDataFrame([], "src long, dst long"))

    @classmethod
    def from_coordinate_edges(cls, rows: DataFrame, scale: float | None = None) -> Graph:
        """From (ux, uy, vx, vy): ends with equal coordinates, or equal keys at `scale`, are one vertex; ids follow (x, y)."""
        key = (lambda c: quantise(c, scale)) if scale else F.col
        keyed = rows.select(*(key(c).alias(f"k{c}") for c in ("ux", "uy", "vx", "vy")), "ux", "uy", "vx", "vy")
        ends = keyed.select(F.col("kux").alias("kx"), F.col("kuy").alias("ky"), F.col("ux").alias("x"), F.col("uy").alias("y")).union(keyed.select("kvx", "kvy", "vx", "vy"))
        points = ends.groupBy("kx", "ky").agg(F.min(F.struct("x", "y")).alias("p")).select("kx", "ky", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
        vertices = numbered(points, ["kx", "ky"], "id")
        a = vertices.select(F.col("kx").alias("kux"), F.col("ky").alias("kuy"), F.col("id").alias("src"))
        b = vertices.select(F.col("kx").alias("kvx"), F.col("ky").alias("kvy"), F.col("id").alias("dst"))
        edges = keyed.join(a, ["kux", "kuy"]).join(b, ["kvx", "kvy"]).select("src", "dst")
        return cls.from_edges(edges, vertices.select("id", "x", "y"))

    # views and changes

    def canonical(self) -> DataFrame:
        """Each undirected edge once, src < dst."""
        return self.edges.where("src < dst")

    def transpose(self) -> Graph:
        return Graph(self.vertices, swapped(self.edges), self.directed)

    def make_undirected(self) -> Graph:
        return Graph(self.vertices, self.edges.unionByName(swapped(self.edges)).distinct(), False)

    def add_edges(self, rows: DataFrame) -> Graph:
        """With (src, dst) rows added, in both directions unless directed; new ends become vertices."""
        more = rows if self.directed else rows.unionByName(swapped(rows))
        ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        missing = ends.join(self.vertices, "id", "left_anti")
        return Graph(self.vertices.unionByName(missing, allowMissingColumns=True), self.edges.unionByName(more, allowMissingColumns=True).dropDuplicates(["src", "dst"]), self.directed)

    def remove_edges(self, rows: DataFrame) -> Graph:
        gone = rows.select("src", "dst")
        gone = gone if self.directed else gone.union(swapped(gone))
        return Graph(self.vertices, self.edges.join(gone, ["src", "dst"], "left_anti"), self.directed)

    def add_vertices(self, rows: DataFrame) -> Graph:
        return Graph(self.vertices.unionByName(rows, allowMissingColumns=True).dropDuplicates(["id"]), self.edges, self.directed)

    def clear_vertex(self, id_: int) -> Graph:
        """Without the edges of a vertex, which stays."""
        return Graph(self.vertices, self.edges.where((F.col("src") != id_) & (F.col("dst") != id_)), self.directed)

    def has_edges(self, asked: DataFrame) -> DataFrame:
        """(src, dst) rows asked for with a boolean `present`."""
        known = self.edges.select("src", "dst").withColumn("present", F.lit(True))
        return asked.join(known, ["src", "dst"], "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def neighbours(self, id_: int) -> DataFrame:
        return self.edges.where(F.col("src") == id_).select(F.col("dst").alias("id"))

    def induced(self, ids: DataFrame) -> Graph:
        """The part on the given ids, which keep their names."""
        keep = ids.select("id").distinct()
        edges = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices.join(keep, "id", "left_semi"), edges, self.directed)

    def without_vertices(self, ids: DataFrame) -> Graph:
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.vertices.join(gone, "id", "left_anti"), edges, self.directed)

    def reindex(self) -> tuple[Graph, DataFrame]:
        """The graph with ids 0..n-1 in id order, and (id, old) pairs."""
        names = numbered(self.vertices.withColumnRenamed("id", "old"), ["old"], "id")
        pairs = names.select("old", "id")
        edges = self.edges.join(pairs.select(F.col("old").alias("src"), F.col("id").alias("s")), "src").join(pairs.select(F.col("old").alias("dst"), F.col("id").alias("d")), "dst")
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(names.select("id", *(c for c in self.vertices.columns if c != "id")), edges.select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest), self.directed), pairs

    def disjoint_union(self, other: Graph, offset: int) -> Graph:
        """With the other graph beside this one, its ids moved by the offset."""
        moved = other.vertices.withColumn("id", F.col("id") + offset)
        edges = other.edges.withColumns({"src": F.col("src") + offset, "dst": F.col("dst") + offset})
        return Graph(self.vertices.unionByName(moved, allowMissingColumns=True), self.edges.unionByName(edges, allowMissingColumns=True), self.directed)

    def degrees(self) -> DataFrame:
        """(id, degree); isolated vertices have 0."""
        n = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def is_undirected(self) -> bool:
        return self.edges.select("src", "dst").join(swapped(self.edges.select("src", "dst")), ["src", "dst"], "left_anti").isEmpty()

    def positions_match(self) -> bool:
        """Whether every end of an edge is a vertex and no vertex is named twice."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return ends.join(self.vertices, "id", "left_anti").isEmpty() and self.vertices.groupBy("id").count().where("count > 1").isEmpty()

    def segments(self, canonical: bool = True) -> DataFrame:
        """(src, dst, x1, y1, x2, y2)."""
        e = (self.canonical() if canonical else self.edges).select("src", "dst")
        a = self.vertices.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        b = self.vertices.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return e.join(a, "src").join(b, "dst").select("src", "dst", "x1", "y1", "x2", "y2")

    def edge_lengths(self, canonical: bool = True) -> DataFrame:
        """(src, dst, w) with Euclidean lengths."""
        return self.segments(canonical).select("src", "dst", dist("x1", "y1", "x2", "y2").alias("w"))

    def weighted(self) -> Graph:
        """With Euclidean lengths as weights, in both directions."""
        return Graph(self.vertices, self.edge_lengths(canonical=False), self.directed)

    def adjacency(self) -> DataFrame:
        """(id, neighbours) with sorted arrays; a vertex's own list is the unit, so a hub's list is one row."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
        return self.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))

    def csr_offsets(self) -> DataFrame:
        """(id, first_out): where each vertex's neighbours begin when all are listed in id order."""
        return running(self.degrees(), ["id"], "degree", "first_out", inclusive=False).select("id", "first_out")

    # random choice, by hashes of ids, so the same whatever the partitioning

    def random_edges(self, k: int, seed: int) -> DataFrame:
        """k edges with equal chances, (src, dst), src < dst."""
        return self.canonical().select("src", "dst", uniform(seed, "src", "dst").alias("u")).orderBy("u", "src", "dst").limit(k).drop("u")

    def random_vertex(self, seed: int) -> DataFrame:
        return self.vertices.select("id", uniform(seed, "id").alias("u")).orderBy("u", "id").limit(1).drop("u")

    def random_incident_edge(self, seed: int) -> DataFrame:
        """A random vertex with edges, and one of its neighbours: an edge with chance 1/deg of its first end."""
        node = self.edges.select("src").distinct().select("src", uniform(seed, "src").alias("u")).orderBy("u", "src").limit(1).drop("u")
        return self.edges.join(F.broadcast(node), "src").select("src", "dst", uniform(seed + 1, "dst").alias("u")).orderBy("u", "dst").limit(1).drop("u")

    def remove_random_edges(self, k: int, seed: int) -> Graph:
        """Without k random edges; all vertices stay."""
        return self.remove_edges(self.random_edges(k, seed))

    def remove_random_edge_connected(self, seed: int, tries: int = 1000) -> tuple[Graph, int, int]:
        """Without one random edge whose ends stay connected, and its ends: random edges are tried in turn until one is no bridge."""
        from .traverse import hop_distance

        for e in self.random_edges(tries, seed).collect():
            left = self.remove_edges(self.edges.sparkSession.createDataFrame([(e.src, e.dst)], "src long, dst long"))
            left = Graph(left.vertices, cut_plan(left.edges), left.directed)
            if not hop_distance(left, e.src, e.dst).isEmpty():
                return left, e.src, e.dst
        raise ValueError(f"none of {tries} random edges can go without parting its ends")

    def thin_to_degrees(self, target: dict[int, float], seed: int, slack: float = 1.2, max_rounds: int = 10_000) -> Graph:
        """Random edges go at vertices of a degree that too many have, from the largest degree down to 2, until at most slack times its share is left; then the largest component.

        A round takes half of the vertices that are too many of one degree (at least one), chosen by a hash, and a random
        edge of each. Above the largest degree that has a share, all vertices lose half of their surplus at once. So rounds
        are logarithmic in degrees, and in the vertices for each degree that has a share.
        """
        from .components import largest_component

        n = self.vertices.count()
        edges = cut_plan(self.canonical().select("src", "dst"))
        most = max((k for k, share in target.items() if share > 0), default=1)
        degree = most
        for turn in range(max_rounds):
            g = Graph(self.vertices, edges.union(swapped(edges)))
            deg = cut_plan(g.degrees())
            counts = {r.degree: r["count"] for r in deg.where(F.col("degree") <= most).groupBy("degree").count().collect()}  # one row a degree with a share
            high = deg.where(F.col("degree") > most).select(F.col("id").alias("src"), F.ceil((F.col("degree") - most) / 2).alias("quota"))
            if not high.isEmpty():
                chosen = high
            else:
                while degree > 1 and counts.get(degree, 0) <= slack * int(target.get(degree, 0.0) * n):
                    degree -= 1
                if degree <= 1:
                    return largest_component(g)
                over = counts[degree] - int(slack * int(target.get(degree, 0.0) * n))
                chosen = deg.where(F.col("degree") == degree).withColumn("u", uniform(seed + turn, "id")).orderBy("u", "id").limit(max(1, over // 2)).select(F.col("id").alias("src"), F.lit(1).cast("long").alias("quota"))
            place = F.row_number().over(Window.partitionBy("src").orderBy(uniform(seed + turn, "src", "dst"), "dst"))
            picked = g.edges.join(chosen, "src").withColumn("place", place).where("place <= quota")
            edges = cut_plan(edges.join(picked.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), ["src", "dst"], "left_anti"))
        raise RuntimeError("degrees did not settle")

    def enforce_average_degree(self, degree: float, seed: int) -> Graph:
        """With floor(n * degree / 2) random edges kept; all vertices stay, a largest component can be taken after."""
        n = self.vertices.count()
        keep = self.random_edges(int(n * degree / 2), seed)
        return Graph(self.vertices, keep.union(swapped(keep)), False)

    def map_weights(self, f: Callable[[Column], Column]) -> Graph:
        return Graph(self.vertices, self.edges.withColumn("w", f(F.col("w"))), self.directed)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with dense numbers from 0 in the given order, which must be total.

    Range partitions are numbered one by one and moved by the sizes of those before, so that no task sees all rows. They
    are checkpointed, as bounds drawn anew could deal rows otherwise.
    """
    parts = cut_plan(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    local = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    starts = sizes.withColumn("__s", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return local.join(F.broadcast(starts), "__p").withColumn(name, F.col("__n") + F.col("__s") - 1).drop("__p", "__n", "__s")


def running(rows: DataFrame, order: list[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Running sum in the given total order, by range partitions like `numbered`."""
    parts = cut_plan(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    local = parts.withColumn("__n", F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = local.groupBy("__p").agg(F.sum(value).alias("__c"))
    starts = sums.withColumn("__s", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    total = F.col("__n") + F.col("__s")
    return local.join(F.broadcast(starts), "__p").withColumn(name, total if inclusive else total - F.col(value)).drop("__p", "__n", "__s")
