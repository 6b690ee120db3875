"""Readers and writers of common graph formats.

Readers go through Spark, so any store it reaches will do, and parse in the JVM or in tasks. Writers sort by range and
stream partition by partition, in order, to one file of any such store, since these formats are single files; the driver
holds one partition.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.disk import DiskGraph
from ..operators.graph import Graph, numbered, running
from ..operators.traverse import multi_sssp
from ..runtime import checkpoint_dir, cut_plan

# text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines with numbers from 0. Offsets of partitions are added to positions within, no task sees all lines."""
    rows = cut_plan(_lines(spark, path).withColumn("at", F.monotonically_increasing_id()))
    return numbered(rows, ["at"], "n").select("n", "value")


def _fields(sep: str = r"\s+") -> list:
    parts = F.split(F.trim("value"), sep)
    return [F.try_element_at(parts, F.lit(i)) for i in range(1, 5)]


def read_vector(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(value): one value a line; a line that isn't one is an error."""
    return _lines(spark, path).select(F.col("value").cast(kind).alias("value"))


def read_points(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(id, x, y) of lines 'x,y' in order; bad lines are dropped."""
    a, b = (F.expr(f"try_cast(trim(try_element_at(split(value, '{sep}'), {k})) AS DOUBLE)") for k in (1, 2))
    rows = _numbered_lines(spark, path).select("n", a.alias("x"), b.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return numbered(rows, ["n"], "id").select("id", "x", "y")


def read_edge_list(spark: SparkSession, path: str, header: int = 1, base: int = 0, drop_trailer: bool = False) -> DataFrame:
    """(src, dst) of lines 'u v' after header lines; malformed lines are dropped. base is the first id in the file; drop_trailer drops a closing '0 0' of 1-based files."""
    ints = [F.expr(f"try_cast(try_element_at(split(trim(value), '[ \\\\t]+'), {k}) AS BIGINT)") for k in (1, 2)]
    rows = _numbered_lines(spark, path).where(F.col("n") >= header) if header else _lines(spark, path)
    e = rows.select((ints[0] - base).alias("src"), (ints[1] - base).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    return e.where("NOT (src < 0 AND dst < 0)") if drop_trailer else e


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Undirected graph of an edge list with one header line."""
    return Graph.from_edges(read_edge_list(spark, path))


def read_pace(spark: SparkSession, path: str) -> Graph:
    """'p tw n m', then 1-based 'u v' lines; comment lines begin with c. All n vertices are kept; a bad line is an error."""
    lines = _lines(spark, path).where("value NOT LIKE 'c%' AND trim(value) <> ''")
    n = lines.where("value LIKE 'p%'").select(F.split("value", r"\s+")[2].cast("long").alias("n")).first()["n"]
    parts = F.split(F.trim("value"), r"\s+")
    edges = lines.where("value NOT LIKE 'p%'").select((parts[0].cast("long") - 1).alias("src"), (parts[1].cast("long") - 1).alias("dst"))
    return Graph.from_edges(edges, spark.range(n))


def read_metis(spark: SparkSession, path: str) -> Graph:
    """'n m', then one line of 1-based neighbours for each vertex; empty lines are isolated vertices."""
    lines = cut_plan(_numbered_lines(spark, path).where("value NOT LIKE '%\\%%'"))
    rows = numbered(lines, ["n"], "line").select("line", "value").where("line > 0")
    near = rows.select((F.col("line") - 1).alias("src"), F.explode(F.split(F.trim("value"), r"\s+")).alias("d")).where("d <> ''")
    return Graph.from_edges(near.select("src", (F.col("d").cast("long") - 1).alias("dst")), rows.select((F.col("line") - 1).alias("id")))


def read_order(spark: SparkSession, path: str, base: int = 1, inverse: bool = False) -> DataFrame:
    """(node, rank) of a text order: line k holds the rank of node k, or with inverse the node of rank k."""
    rows = _numbered_lines(spark, path).where("trim(value) <> ''").select(F.col("n"), (F.trim("value").cast("long") - base).alias("v"))
    return rows.select(F.col("v").alias("node"), F.col("n").alias("rank")) if inverse else rows.select(F.col("n").alias("node"), F.col("v").alias("rank"))


def read_flow_cutter_stats(spark: SparkSession, path: str) -> DataFrame:
    """(n, s) from the first and third columns of a CSV file with a header."""
    rows = spark.read.csv(path, header=True)
    return rows.select(rows[0].cast("long").alias("n"), rows[2].cast("long").alias("s"))


def read_osm(spark: SparkSession, path: str, axis_order: str = "lonlat") -> Graph:
    """Nodes and ways of OSM XML: consecutive references of a way are edges; vertices are nodes that are referenced and have a position; ids are the OSM ids (reindex() makes them dense). No tags are read."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path).where("_id IS NOT NULL AND _lat IS NOT NULL AND _lon IS NOT NULL").dropDuplicates(["_id"])
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref:long>>").load(path).where("size(nd) > 1")
    pairs = ways.select(F.explode(F.arrays_zip(F.slice("nd._ref", F.lit(1), F.size("nd") - 1).alias("a"), F.slice("nd._ref", F.lit(2), F.size("nd") - 1).alias("b"))).alias("p")).select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"))
    x, y = ("_lon", "_lat") if axis_order == "lonlat" else ("_lat", "_lon")
    known = nodes.select(F.col("_id").alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    edges = pairs.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    used = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph.from_edges(edges, known.join(used, "id", "left_semi"))


@contextmanager
def _file(spark: SparkSession, path: str, append: bool = False) -> Iterator:
    """A function that writes bytes to one file of any store that Spark reaches. It appears under its name when it is whole."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = to.getFileSystem(conf)
    fs.setWriteChecksum(False)
    stream = fs.create(part, True)
    held: list[bytes] = []
    size = 0

    def write(data: bytes) -> None:
        nonlocal size
        held.append(data)
        size += len(data)
        if size >= 1 << 20:
            flush()

    def flush() -> None:
        nonlocal size
        if held:
            stream.write(bytearray(b"".join(held)))
        held.clear()
        size = 0

    try:
        if append and fs.exists(to):
            old = fs.open(to)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(old, stream, 1 << 16, False)
            old.close()
        yield write
        flush()
    except BaseException:
        stream.close()
        fs.delete(part, False)
        raise
    stream.close()
    fs.delete(to, False)
    fs.rename(part, to)


def _write_lines(spark: SparkSession, path: str, lines: Iterable[str], append: bool = False) -> None:
    with _file(spark, path, append) as write:
        for x in lines:
            write(x.encode() + b"\n")


def _in_order(df: DataFrame, *keys: str) -> Iterable:
    return df.orderBy(*keys).toLocalIterator(prefetchPartitions=True)


def write_vector(df: DataFrame, column: str, path: str, append: bool = False, order: str | None = None) -> None:
    """One value a line, in the order of the values or of another column; append adds to a file."""
    by = order or column
    _write_lines(df.sparkSession, path, (str(r[0]) for r in _in_order(df.select(column, F.col(by).alias("__by")), "__by")), append)


def clear_file(spark: SparkSession, path: str) -> None:
    _write_lines(spark, path, ())


def write_points(points: DataFrame, path: str, sep: str = " ") -> None:
    """'x y' lines in id order."""
    _write_lines(points.sparkSession, path, (f"{r.x!r}{sep}{r.y!r}" for r in _in_order(points.select("id", "x", "y"), "id")))


def _edge_lines(g: Graph, base: int) -> Iterator[str]:
    return (f"{r.src + base} {r.dst + base}" for r in _in_order(g.canonical().select("src", "dst"), "src", "dst"))


def _dense(g: Graph) -> tuple[Graph, int, int]:
    """With ids from 0, and the numbers of vertices and edges."""
    h, _ = g.reindex()
    return h, h.vertices.count(), h.canonical().count()


def write_edge_list(g: Graph, path: str) -> None:
    """'n m', then 0-based 'u v' lines."""
    h, n, m = _dense(g)
    _write_lines(g.vertices.sparkSession, path, chain([f"{n} {m}"], _edge_lines(h, 0)))


def write_pace(g: Graph, path: str) -> None:
    """'p tw n m', then 1-based 'u v' lines."""
    h, n, m = _dense(g)
    _write_lines(g.vertices.sparkSession, path, chain([f"p tw {n} {m}"], _edge_lines(h, 1)))


def write_metis(g: Graph, path: str) -> None:
    """'n m', then a line of 1-based neighbours for each vertex."""
    h, n, m = _dense(g)
    rows = h.adjacency().select("id", F.array_join(F.transform("neighbours", lambda x: (x + 1).cast("string")), " ").alias("line"))
    _write_lines(g.vertices.sparkSession, path, chain([f"{n} {m}"], (r.line for r in _in_order(rows, "id"))))


def write_pigale(g: Graph, path: str) -> None:
    """'PIG:0 Graph', 1-based edges, '0 0'."""
    _write_lines(g.vertices.sparkSession, path, chain(["PIG:0 Graph"], _edge_lines(g.reindex()[0], 1), ["0 0"]))


def write_separators(rows: DataFrame, path: str) -> None:
    """'n s' lines, largest first."""
    _write_lines(rows.sparkSession, path, (f"{r.n} {r.s}" for r in rows.select("n", "s").orderBy(F.desc("n"), F.desc("s")).toLocalIterator()))


def read_separators(spark: SparkSession, path: str) -> DataFrame:
    a, b, *_ = _fields()
    return _lines(spark, path).select(a.cast("long").alias("n"), b.cast("long").alias("s"))


def write_histogram(hist: DataFrame, path: str) -> None:
    """Edges on the first line, counts on the second."""
    rows = hist.orderBy("bin").collect()  # one row a bin
    edges = [r.lo for r in rows] + [r.hi for r in rows[-1:]]
    _write_lines(hist.sparkSession, path, [" ".join(map(repr, edges)), " ".join(str(r.cnt) for r in rows)])


def _write_parts(df: DataFrame, path: str) -> None:
    """A string column's lines as one file: tasks write their parts in order, which are moved behind one another in the JVM."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    at = f"{checkpoint_dir(spark)}/parts-{uuid.uuid4().hex}"
    df.write.text(at)
    conf = spark._jsc.hadoopConfiguration()
    folder, to = jvm.org.apache.hadoop.fs.Path(at), jvm.org.apache.hadoop.fs.Path(path)
    parts, fs = folder.getFileSystem(conf), to.getFileSystem(conf)
    whole = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs.setWriteChecksum(False)
    stream = fs.create(whole, True)
    for name in sorted(f.getPath().getName() for f in parts.listStatus(folder) if f.getPath().getName().startswith("part-")):
        part = jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        data = parts.open(part)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, stream, 1 << 20, False)
        data.close()
        parts.delete(part, False)
    stream.close()
    parts.delete(folder, True)
    fs.delete(to, False)
    fs.rename(whole, to)


def _as_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            yield pa.RecordBatch.from_pydict({"value": ["\n".join(map(repr, batch["w"][k].values.to_numpy().tolist()))]})


def write_edge_lengths(g: Graph, path: str) -> None:
    """One length a line for each directed edge."""
    if isinstance(g, DiskGraph):
        _write_parts(g.lists().select("id", "w").orderBy("id").select("w").mapInArrow(_as_lines, "value string"), path)
        return
    _write_lines(g.vertices.sparkSession, path, (repr(r.w) for r in _in_order(g.edge_lengths(canonical=False), "src", "dst")))


def write_distances(g: Graph, sources: DataFrame, path: str) -> None:
    """One weighted distance a line, from each source (id) to all that it reaches, sources one after another."""
    d = cut_plan(multi_sssp(g, sources))
    _write_lines(g.vertices.sparkSession, path, (repr(r.d) for r in _in_order(d, "source", "id")))


# binary


def read_binary_vector(spark: SparkSession, path: str, kind: str = "I") -> DataFrame:
    """(pos, value) of a little-endian vector of struct type `kind` (I u32, i i32, f f32, d f64, Q u64).

    The file is split over tasks by records of up to 4,096 values each, which numpy decodes.
    """
    width = struct.calcsize("<" + kind)
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("length").first()[0]
    if size % width:
        raise ValueError(f"{path}: {size} bytes are no whole number of {width}-byte values")
    n = size // width
    out = pa.schema([("pos", pa.int64()), ("value", pa.float64() if kind in "fd" else pa.int64())])
    code = np.dtype(CODES[kind])
    if not n:
        return spark.createDataFrame([], f"pos long, value {'double' if kind in 'fd' else 'long'}")
    records, each = _records(spark, path, width, n)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["at"].to_numpy()
            values = np.frombuffer(b"".join(batch["raw"].to_pylist()), code).astype(out.field("value").type.to_pandas_dtype())
            pos = (at[:, None] * each + np.arange(each)).ravel()
            there = pos < n
            yield pa.RecordBatch.from_arrays([pa.array(pos[there]), pa.array(values[there])], schema=out)

    return records.mapInArrow(decode, f"pos long, value {'double' if kind in 'fd' else 'long'}")


CODES = {"I": "<u4", "i": "<i4", "f": "<f4", "d": "<f8", "Q": "<u8"}


def _records(spark: SparkSession, path: str, width: int, n: int) -> tuple[DataFrame, int]:
    """(at, raw): records of as many values as the second result says, numbered. If no good number divides n, a copy is read that zeros fill up to one."""
    each = next(k for k in range(min(4096, n), 0, -1) if n % k == 0)
    if each < 256 and n > 4096:
        each = 4096
        jvm, conf, copy = spark._jvm, spark._jsc.hadoopConfiguration(), f"{checkpoint_dir(spark)}/vector-{uuid.uuid4().hex}"
        old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(copy)
        fs = old.getFileSystem(conf)
        stream, data = new.getFileSystem(conf).create(new, True), fs.open(next(f.getPath() for f in fs.listStatus(old)))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, stream, 1 << 20, False)
        data.close()
        stream.write(bytearray(width * (-n % each)))
        stream.close()
        path = copy
    records = spark.sparkContext.binaryRecords(path, width * each).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    return spark.createDataFrame(records, "at long, raw binary"), each


def _owned(spark: SparkSession, path: str, ranges: DataFrame, m: int) -> DataFrame:
    """(src, dst), each once: the m heads with the vertices whose ranges (pos, value, end) hold them."""
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("length").first()[0]
    if size < 4 * m:
        raise ValueError(f"{path}: {size} bytes are too few for {m} heads")
    records, each = _records(spark, path, 4, size // 4)
    parts = ranges.withColumn("at", F.explode(F.sequence(F.expr(f"value div {each}"), F.expr(f"(end - 1) div {each}"))))
    near = parts.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("value", "end", "pos"))).alias("ranges"))
    both = records.join(near, "at")

    def spread(row: dict) -> tuple[np.ndarray, np.ndarray]:
        heads = np.frombuffer(row["raw"], "<u4").astype(np.int64)
        lo = row["at"] * each
        start = np.array([max(r["value"], lo) - lo for r in row["ranges"]], np.int64)
        end = np.array([min(r["end"], lo + each) - lo for r in row["ranges"]], np.int64)
        src = np.repeat(np.array([r["pos"] for r in row["ranges"]], np.int64), end - start)
        return src, np.concatenate([heads[a:b] for a, b in zip(start, end, strict=True)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                src, dst = spread(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_pydict({"src": src, "dst": dst})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                src, dst = spread(row)
                grows = bool(((src[1:] != src[:-1]) | (dst[1:] > dst[:-1])).all())
                yield pa.RecordBatch.from_pydict({"at": [row["at"]], "s": src[:1], "d": dst[:1], "s2": src[-1:], "d2": dst[-1:], "grows": [grows]})

    seen = cut_plan(both.mapInArrow(ends, "at long, s long, d long, s2 long, d2 long, grows boolean"))
    after = seen.select((F.col("at") - 1).alias("at"), F.col("s").alias("s3"), F.col("d").alias("d3"))
    repeats = seen.join(after, "at", "left").where("NOT grows OR (s2 = s3 AND d3 <= d2)")
    edges = both.mapInArrow(decode, "src long, dst long")
    return edges if repeats.isEmpty() else edges.distinct()


def read_csr(spark: SparkSession, path: str, directed: bool = False, positions: bool = False, axis_order: str = "latlon") -> Graph:
    """Folder with first_out (n + 1 offsets) and head, and with positions also latitude and longitude.

    A head at position p belongs to the vertex whose range of offsets holds p. Records of heads meet the ranges that they
    overlap, and repeated edges go unless all heads of each vertex increase, so that there are none.
    """
    first = cut_plan(read_binary_vector(spark, f"{path}/first_out"))
    following = first.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("end"))
    ranges = first.join(following, "pos").where("value < end")
    m = first.agg(F.max("value")).first()[0] or 0
    edges = _owned(spark, f"{path}/head", ranges, m) if m else spark.createDataFrame([], "src long, dst long")
    n = first.agg(F.max("pos")).first()[0]
    vertices = spark.range(n)
    if positions:
        lat, lon = (read_binary_vector(spark, f"{path}/{c}", "f").toDF("id", c) for c in ("latitude", "longitude"))
        x, y = ("latitude", "longitude") if axis_order == "latlon" else ("longitude", "latitude")
        vertices = lat.join(lon, "id").select("id", F.col(x).alias("x"), F.col(y).alias("y"))
    return Graph(vertices, edges, directed)


def _write_binary(spark: SparkSession, path: str, kind: str, values: Iterable) -> None:
    code = struct.Struct("<" + kind)
    with _file(spark, path) as write:
        for v in values:
            write(code.pack(v))


def write_binary_vector(df: DataFrame, column: str, order: str, path: str, kind: str = "I") -> None:
    """The column's values in the order of another one, as little-endian values of a struct type."""
    _write_binary(df.sparkSession, path, kind, (r[1] for r in _in_order(df.select(order, column), order)))


def write_csr(g: Graph, path: str) -> None:
    """first_out and head as 32-bit numbers, and latitude (x) and longitude (y) as 32-bit floats if there are positions."""
    spark = g.vertices.sparkSession
    h, _ = g.reindex()
    if isinstance(h, DiskGraph):
        h = DiskGraph(cut_plan(h.vertices), h.radius)
        degrees = cut_plan(h.degrees())
        offsets = running(degrees, ["id"], "degree", "first_out", inclusive=False)
        total = degrees.agg(F.sum("degree")).first()[0] or 0
        heads = (bytes(r.heads) for r in _in_order(h.lists().select("id", "heads"), "id"))
        with _file(spark, f"{path}/head") as write:
            for x in heads:
                write(x)
    else:
        h = Graph(cut_plan(h.vertices), cut_plan(h.edges), h.directed)
        offsets = h.csr_offsets()
        total = h.edges.count()
        _write_binary(spark, f"{path}/head", "i", (r.dst for r in _in_order(h.edges.select("src", "dst"), "src", "dst")))
    _write_binary(spark, f"{path}/first_out", "i", chain((r.first_out for r in _in_order(offsets, "id")), [total]))
    if "x" in h.vertices.columns:
        for c, name in (("x", "latitude"), ("y", "longitude")):
            _write_binary(spark, f"{path}/{name}", "f", (r[1] for r in _in_order(h.vertices.select("id", c), "id")))
