"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its word 5-grams. Texts with equal sets form a class, which takes part once, with its number of
copies. Classes that agree on a MinHash band are candidates; their MinHash values are compared some at a time, and a pair
is dropped as soon as the posterior probability that its similarity reaches the threshold falls below the tolerance
(BayesLSH). What remains ties classes into clusters, and within a cluster all pairs that pass the same test are verified
on the 5-gram sets themselves, so every reported link is exact and counted once.

No pair is a row. A bucket larger than a block is first tied by blocks and by one block that all are compared with, which
moves each signature twice; only members of different components that are left are then compared block by block. Texts
of cluster members are fetched once and become differences from the cluster's first text; of large clusters only these
and the signatures are copied to pairs of blocks, which are bounded in rows and bytes. Each returns sums of links for
each class and a spanning forest of its links. The number of links is exact, so a cluster of n different texts takes n^2
comparisons, spread over its pairs of blocks. A link at exactly the threshold escapes the bands with probability
(1 - t^4)^20, 3e-5 at 0.8, less above.

Defined results: a text of 1 to 4 words has one gram, the whole of it; texts without words (null, empty) are linked with
nothing and are their own class; rows with null ids take part, and class_id is the smallest id of the class that isn't
null; repeated rows are copies of each other; very long texts take part whole; an empty table gives no rows; other
columns, whatever their names, pass through `drop_near_duplicates` and aren't read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import star_forest
from ..runtime import cut_lineage, stored
from .text import arrow_schema, col, fold_words, per_batch, pieces, whole_row

GRAM, HASHES, BANDS, ROWS, STEP = 5, 128, 20, 4, 32


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


MIX, SCALE, ADD = _splitmix(GRAM + 1, 1) | np.uint64(1), _splitmix(HASHES, 2) | np.uint64(1), _splitmix(HASHES, 3)


def gram_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word 5-grams."""
    words = fold_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(GRAM, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64) * MIX[GRAM]
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * MIX[i]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def minhash(grams: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima; long sets are taken in slices."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(grams), 1024):
        x = np.multiply.outer(grams[at : at + 1024], SCALE)
        x += ADD
        x >>= np.uint64(32)
        np.minimum(low, x.min(0), out=low)
    return low.astype(np.uint32)


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the least number of matches with a posterior chance of the threshold of at least the tolerance.

    Values are kept to 8 bits, so they match with probability q = s + (1 - s) / 256. With q uniform beforehand, the
    posterior chance of q >= c after m of n matches is that of at most m successes in n + 1 tries at c.
    """
    c = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (a[i], b[i]) of signature rows pass all incremental tests."""
    left, got = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        at = slice(k * STEP, (k + 1) * STEP)
        got = got + (sig[a[left], at] == sig[b[left], at]).sum(1, dtype=np.int32)
        ok = got >= need
        left, got = left[ok], got[ok]
        if not len(left):
            break
    return left


class Forest:
    """Union-find over positions, with all roots at hand as an array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root, changed = self.root, False
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                self.edges.append((x, y))
                changed = True
        while changed:
            up = root[root]
            changed = bool((up != root).any())
            root = up
        self.root = root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by the keys, with the number of each row's group in the table."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = _changes(batch, keys)
        cut = int(np.flatnonzero(edge)[-1]) if edge.any() else 0
        if not cut and rest and not _same(rest[-1], batch, keys):
            yield _numbered(rest, keys)
            rest = []
        if cut:
            yield _numbered([*rest, batch.slice(0, cut)], keys)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield _numbered(rest, keys)


def _changes(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    out = np.zeros(rows.num_rows, bool)
    for k in keys:
        v = rows[k].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows[k].to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a[k][a.num_rows - 1] == b[k][0] for k in keys)


def _numbered(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return table, _changes(table, keys).cumsum()


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)


def _dealt(members: DataFrame, key: str, n: str, node: str) -> DataFrame:
    """Members of a group, split by a hash into its n blocks and copied to each pair (i, j) of blocks that has theirs."""
    own = members.withColumn("own", F.pmod(F.xxhash64(node, F.lit(7)), F.col(n)).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    return _sorted(pairs.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", n), key, node)


def _sorted(pairs: DataFrame, key: str, node: str) -> DataFrame:
    return pairs.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "own", node)


def _pairs(group: np.ndarray, crossed: np.ndarray, own: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within groups, by distance; in a group of two blocks only pairs across them."""
    n = len(group)
    for k in range(1, n):
        a = np.flatnonzero(group[:-k] == group[k:])
        if not len(a):
            return
        a = a[~crossed[a] | (own[a] != own[a + k])]
        for at in range(0, len(a), most):
            yield a[at : at + most], a[at : at + most] + k


def text_classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, text hash and digest of each row, and for each digest its node, rep (an id), rep_th (and its text's hash), copies, sig and bands."""

    def sign(ids: list, ths: list, texts: list) -> dict:
        out: dict = {"doc_id": ids, "th": ths, "cid": [], "sig": [], "bands": [], "grams": []}
        for t in texts:
            grams = gram_set(t)
            if not len(grams):
                out["cid"].append(None), out["sig"].append(None), out["bands"].append(None), out["grams"].append(0)
                continue
            h = minhash(grams)
            out["cid"].append(digest(grams))
            out["grams"].append(len(grams))
            out["sig"].append((h & 255).astype(np.uint8).tobytes())
            out["bands"].append([xxhash.xxh3_64_intdigest(h[ROWS * k : ROWS * (k + 1)].tobytes(), k) - (1 << 63) for k in range(BANDS)])
        return out

    rows = cut_lineage(per_batch(docs, [col(doc_id).cast("long"), F.xxhash64(col(text)), text], sign, "doc_id long, th long, cid binary, sig binary, bands array<long>, grams int").withColumn("uid", F.monotonically_increasing_id()))
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "uid")).alias("r"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("grams").cast("long").alias("grams"))
    classes = cut_lineage(classes.select("cid", F.col("r.uid").alias("node"), F.col("r.doc_id").alias("rep"), F.col("r.th").alias("rep_th"), "copies", "sig", "bands", "grams"))
    return rows.select("doc_id", "th", "cid"), classes


def candidate_clusters(classes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(id, component): nodes tied by band collisions whose MinHash values pass the Bayesian test."""
    least = least_matches(threshold, tolerance)
    bands = classes.select("node", F.explode("bands").alias("band"))
    often = stored(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = bands.join(often, "band").join(classes.select("node", "sig"), "node")
    schema = "a long, b long"
    out = arrow_schema(schema)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["band", "i", "j"]):
            node, sig = table["node"].to_numpy(), _signatures(table)
            own, crossed = table["own"].to_numpy(), table["i"].to_numpy() != table["j"].to_numpy()
            # a node stands once for all its groups here, so what one band has tied isn't compared again for another
            names, place = np.unique(node, return_inverse=True)
            forest = Forest(len(names))
            known, tied = table["tied"].to_numpy(zero_copy_only=False), np.zeros(0, np.int64)
            if not np.isnan(known.astype(float)).all():
                tied = known.astype(np.int64)
            for a, b in _pairs(group, crossed, own):
                new = forest.root[place[a]] != forest.root[place[b]]
                if len(tied):
                    new &= tied[a] != tied[b]
                a, b = a[new], b[new]
                ok = surviving(sig, a, b, least)
                forest.join(place[a[ok]], place[b[ok]])
            ends = np.array(forest.edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[ends[:, 0]]), pa.array(names[ends[:, 1]])], schema=out)

    # each block by itself, and the first block with every other one: any row is copied once more at most, on average
    n = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = members.withColumns({"n": n, "own": F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")})
    with_first = own.withColumn("j", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array("own"))))
    near = with_first.select("band", "node", "sig", "own", F.lit(0).alias("i"), "j", F.lit(None).cast("long").alias("tied"))
    ties = cut_lineage(_sorted(near, "band", "node").mapInArrow(tie, schema))
    found = star_forest(ties, "a", "b")
    large = often.where(F.col("size") > block)
    if large.isEmpty():
        return found
    large = bands.join(large, "band").join(classes.select("node", "sig"), "node")
    large = stored(large.join(found.withColumnRenamed("id", "node"), "node", "left").select("band", "node", "sig", F.coalesce("component", "node").alias("tied")))
    parts = large.groupBy("band", "tied").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max(F.struct("m", "tied")).alias("top"), F.sum("m").alias("size")).where("top.m < size")
    parts = parts.select("band", F.col("top.tied").alias("top"), F.ceil(F.col("top.m") / F.lit(block)).cast("int").alias("n_top"), F.ceil((F.col("size") - F.col("top.m")) / F.lit(block)).cast("int").alias("n_rest"))
    left = large.join(parts, "band").withColumn("in_top", F.col("tied") == F.col("top"))
    # blocks of the largest component are -1, -2, ..; they meet those of the rest only
    left = left.withColumn("own", F.when(F.col("in_top"), -1 - F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_top"))).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_rest"))).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.when(F.col("in_top"), F.lit(0)).otherwise(-F.col("n_top")), F.col("n_rest") - 1)))
    left = left.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("band", "node", "sig", "own", "i", "j", "tied")
    more = cut_lineage(_sorted(left, "band", "node").mapInArrow(tie, schema))
    return found if more.isEmpty() else star_forest(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "a", "b")


def differences(full: DataFrame) -> DataFrame:
    """(component, n, node, copies, sig, base, size, gone, added) of members with their texts: a text's grams as those of the cluster's first text, without the places gone and with the hashes added.

    The first text goes along with each slice of its cluster.
    """
    slices = full.withColumn("is_first", F.col("node") == F.col("component"))
    slices = slices.withColumn("slice", F.explode(F.when(F.col("is_first"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(11)), F.col("n")).cast("int")))))
    slices = slices.select("component", "slice", "is_first", "node", "n", "copies", "sig", "body").repartition("component", "slice").sortWithinPartitions("component", "slice", F.desc("is_first"), "node")
    schema = "component long, n int, node long, copies long, sig binary, base int, size int, gone binary, added binary"
    out = arrow_schema(schema)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last = None, np.empty(0, np.uint64), None
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for component, piece, is_first, node, n, copies, sig, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (component, piece) != at:
                        at, first, last = (component, piece), gram_set(body), None
                    if node == last:  # rows repeated with one id and text stand for one class
                        continue
                    last = node
                    if is_first and piece:
                        continue
                    grams = first if is_first else gram_set(body)
                    gone = np.flatnonzero(~np.isin(first, grams, assume_unique=True)).astype("<i4")
                    rows.append((component, n, node, copies, sig, len(first), len(grams), gone.tobytes(), np.setdiff1d(grams, first, assume_unique=True).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return slices.mapInArrow(differ, schema)


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, one row after another, and where each row begins."""
    lists = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(lists), kind), np.r_[0, np.cumsum([len(x) // width for x in lists])]


def verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, tolerance: float, block: int, doc_id: str, text: str, block_bytes: int = 16 << 20) -> DataFrame:
    """(node, links, peer) rows: parts of the node's number of linked documents of other classes, or an edge of a spanning forest of links."""
    least = least_matches(threshold, tolerance)
    members = clusters.join(classes.select(F.col("node").alias("id"), "rep", "rep_th", "copies", "sig", "grams"), "id").withColumnRenamed("id", "node")
    # the first member of a component is the node that names it
    size = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(2 * block)), F.ceil(F.sum("grams") * 8 / F.lit(block_bytes))).cast("int").alias("n"))
    wanted = members.join(size, "component").select("component", "n", "node", "rep", "rep_th", "copies", "sig")
    bodies = docs.select(col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("th"), col(text).alias("body"))
    full = wanted.join(bodies, (wanted["rep_th"] == bodies["th"]) & wanted["rep"].eqNullSafe(bodies["id"]))
    schema = "node long, links long, peer long"
    out = arrow_schema(schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["component", "i", "j"]):
            node, sig, copies = table["node"].to_numpy(), _signatures(table), table["copies"].to_numpy()
            own, crossed = table["own"].to_numpy(), table["i"].to_numpy() != table["j"].to_numpy()
            base, size = table["base"].to_numpy(), table["size"].to_numpy().astype(np.int64)
            gone, gone_at = _flat(table["gone"], "<i4")
            added, added_at = _flat(table["added"], "<u8")
            links, forest = np.zeros(len(node), np.int64), Forest(len(node))
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(node)], strict=True):
                split = lo + int(np.searchsorted(own[lo:hi], own[lo], "right"))  # sorted by block: the second one begins here
                for k in range(lo, split if crossed[lo] else hi - 1):
                    b = np.arange(split if crossed[lo] else k + 1, hi)
                    b = b[surviving(sig, np.full(len(b), k), b, least)]
                    if not len(b):
                        continue
                    mark = np.zeros(base[lo], bool)
                    mine = gone[gone_at[k] : gone_at[k + 1]]
                    mark[mine] = True
                    new = added[added_at[k] : added_at[k + 1]]
                    both_gone = _sums(mark[gone[gone_at[b[0]] : gone_at[hi]]], gone_at, b)
                    both_new = _sums(_within(added[added_at[b[0]] : added_at[hi]], new), added_at, b)
                    common = base[lo] - len(mine) - (gone_at[b + 1] - gone_at[b]) + both_gone + both_new
                    ok = b[common >= threshold * (size[k] + size[b] - common) - 1e-9]
                    links[k] += copies[ok].sum()
                    links[ok] += copies[k]
                    far = ok[forest.root[ok] != forest.root[k]]
                    forest.join(np.full(len(far), k), far)
            ends = np.array(forest.edges, np.int64).reshape(-1, 2)
            some = np.flatnonzero(links)
            no_peer = np.arange(len(some) + len(ends)) < len(some)
            columns = np.r_[node[some], node[ends[:, 0]]], np.r_[links[some], np.zeros(len(ends), np.int64)], np.r_[node[some], node[ends[:, 1]]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=no_peer)], schema=out)

    return _dealt(differences(full), "component", "n", "node").mapInArrow(verify, schema)


def _within(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def _sums(marks: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of marks of each of the (ascending) rows; marks begin with the first of them."""
    total = np.r_[0, np.cumsum(marks)]
    return total[at[rows + 1] - at[rows[0]]] - total[at[rows] - at[rows[0]]]


def _joined(docs: DataFrame, threshold: float, tolerance: float, block: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, named): named has cid, n_links, n_class, and class_id and class_th of the row that stands for its group."""
    rows, classes = text_classes(docs, doc_id, text)
    clusters = candidate_clusters(classes, threshold, tolerance, block)
    found = cut_lineage(verified_links(docs, classes, clusters, threshold, tolerance, block, doc_id, text))
    groups = star_forest(found.where("peer IS NOT NULL"), "node", "peer")
    sums = found.where("peer IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    # stored, so that the join below has an exchange of its own, whose partition of a large group Spark can split
    named = stored(
        classes.select("cid", "node", "rep", "rep_th", "copies")
        .join(sums, "node", "left")
        .join(groups.withColumnRenamed("id", "node"), "node", "left")
        .select("cid", "rep", "rep_th", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "rep_th"))
    ids = stored(named.groupBy("component").agg(first["rep"].alias("class_id"), first["rep_th"].alias("class_th"), F.sum("copies").alias("n_class")))
    return rows, named.join(ids, "component").select("cid", "class_id", "class_th", "n_links", "n_class")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5, block: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id that it is linked with, over any number of links), n_links (documents of at least that similarity), n_class."""
    rows, named = _joined(docs, threshold, tolerance, block, doc_id, text)
    wordless = rows.where("cid IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_class"))
    return rows.join(named, "cid").select("doc_id", "class_id", "n_links", "n_class").union(wordless)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5, block: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each class, that of the smallest id (then text hash); texts without words all stay. All columns stay."""
    rows, named = _joined(docs, threshold, tolerance, block, doc_id, text)
    kept = named.select("class_id", "class_th", F.lit(True).alias("one")).distinct().union(rows.where("cid IS NULL").select("doc_id", "th", F.lit(False)).distinct())
    own = docs.select(whole_row(docs).alias("row"), col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("th"))
    both = own.join(kept, own["id"].eqNullSafe(kept["class_id"]) & (own["th"] == kept["class_th"])).select("row", "id", "th", "one")
    # rows repeated with one id and text: the first of them stays
    same = Window.partitionBy("id", "th", F.when(F.col("one"), F.lit(0)).otherwise(F.monotonically_increasing_id())).orderBy(F.lit(0))
    return both.withColumn("turn", F.row_number().over(same)).where("turn = 1").select("row.*")
