"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Document tokens stream through the automaton, which tracks the longest match ending at each token. A token is *hit*
if it lies inside any occurrence of a window: ``window`` consecutive words of an item, or the whole of a shorter item.
`contamination` reports hits; `decontaminate` removes long runs of them and drops documents that are mostly hits.

A benchmark of at most ``broadcast_bytes`` of text is taken to the driver, and its automata are broadcast. Nothing of a
larger one passes through the driver but a bitmap of ``filter_bits`` bits: windows are hashed in tasks, documents whose
windows pass the bitmap are joined with the windows' hashes, and each document goes only to the blocks of items with
which it shares one. The automaton of a block is built in the tasks that match its documents; a block that many
documents need is built in several.

Defined results: null or wordless texts have no words and no hits; items without words match nothing; items with a null
id hit but aren't listed; equal items are both listed, repeated ids once; every row is judged on its own, so repeated
rows give repeated results; very long texts and items are matched whole; an empty benchmark gives no hits; other columns
of the documents, whatever their names, pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .text import WORD, arrow_schema, col, fold_words, per_batch, pieces, whole_row, with_text


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items that own each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._own(coded)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest string followed by c, cut out of q if q's strings are longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = short
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _own(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """at_window: the state of the last `window` words for each state that is long enough; owners: its items; short: whole shorter items."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.at_window: list[int] = [-1] * len(order)
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for s in order[1:]:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.at_window[s] = self.at_window[up] if self.length[up] >= self.window else s
        self.least = self.window
        for name, ids in coded:
            s = 0
            for n, c in enumerate(ids, 1):
                s = self.next[s][c]
                if n >= self.window:
                    self.owners.setdefault(self.at_window[s], set()).update(() if name is None else (name,))
            if len(ids) < self.window:
                self.short.setdefault(s, []).append((len(ids), name))
                self.least = min(self.least, len(ids))
        for s in order[1:]:
            if up := self.short.get(self.link[s]):
                self.short[s] = self.short.get(s, []) + up

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs (start, end) of hit words, and the names of the items with occurring windows."""
        follow, link, length, short, window, least = self.next, self.link, self.length, self.short, self.window, self.least
        runs: list[list[int]] = []
        found: set[int] = set()
        names: set[str] = set()
        state = size = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                state = size = 0
                continue
            to = follow[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = follow[state].get(c)
            if to is None:
                continue
            state = to
            size += 1
            if size < least:
                continue
            reach = 0
            if size >= window:
                reach = size
                found.add(self.at_window[state])
            if state in short:
                for n, name in short[state]:
                    if n <= size:
                        reach = max(reach, n)
                        if name is not None:
                            names.add(name)
            if reach:
                lo = i + 1 - reach
                if runs and runs[-1][0] <= lo <= runs[-1][1]:
                    runs[-1][1] = i + 1
                else:
                    runs.append([lo, i + 1])
        for s in found:
            names |= self.owners[s]
        return _merged(runs), names


def _merged(runs: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _automata(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> list:
    """Broadcast automata, each of a block of at most block_words words of items (or one longer item); for benchmarks of a checked size only."""
    sc = items.sparkSession.sparkContext
    blocks, block, size = [], [], 0
    for name, body in items.select(col(item_id).cast("string"), col(text)).collect():
        words = fold_words(body)
        if block and size + len(words) > block_words:
            blocks.append(sc.broadcast(SuffixAutomaton(block, window)))
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block or not blocks:
        blocks.append(sc.broadcast(SuffixAutomaton(block, window)))
    return blocks


Found = tuple[list[tuple[int, int]], set[str]]


def _matches(blocks: list, lists: list[list[bytes]]) -> list[Found]:
    if len(blocks) == 1:
        return list(map(blocks[0].value.match, lists))
    runs: list[list] = [[] for _ in lists]
    names: list[set[str]] = [set() for _ in lists]
    for b in blocks:
        automaton = b.value
        for k, words in enumerate(lists):
            r, n = automaton.match(words)
            runs[k] += r
            names[k] |= n
        del automaton
        b.__dict__.pop("_value", None)  # read again from its file for the next batch; one block in memory at a time
    return [(_merged(r), n) for r, n in zip(runs, names, strict=True)]


#: An odd multiplier and its inverse modulo 2^64, for hashes of windows at any place.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def window_hashes(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """Distinct 64-bit hashes of all windows of these sizes."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    up = np.r_[np.uint64(1), np.full(n, _STEP, np.uint64)].cumprod(dtype=np.uint64)
    down = np.r_[np.uint64(1), np.full(n, _BACK, np.uint64)].cumprod(dtype=np.uint64)
    sums = np.r_[np.uint64(0), (h * up[:n]).cumsum(dtype=np.uint64)]
    out = [np.empty(0, np.uint64)]
    for k in sizes:
        if k <= n:
            x = (sums[k:] - sums[: n + 1 - k]) * down[: n + 1 - k] + np.uint64(k)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(x ^ x >> np.uint64(32))
    return np.unique(np.concatenate(out))


def _bitmap(hashes: DataFrame, bits: int, part_bits: int = 1 << 19) -> np.ndarray:
    """Bits of the `h` column's hashes; tasks set bits in parts, the parts are united before they come to the driver."""
    part_bits = min(bits, part_bits)
    schema = "part int, bits binary"
    out = arrow_schema(schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch["h"].to_numpy().view(np.uint64) % np.uint64(bits)
            for p in np.unique(at // np.uint64(part_bits)):
                own = parts.setdefault(int(p), np.zeros(part_bits, bool))
                own[at[at // np.uint64(part_bits) == p] % np.uint64(part_bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], schema=out)

    def unite(rows: pa.Table) -> pa.Table:
        united = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"].to_pylist()])
        return pa.table([pa.array([rows["part"][0].as_py()], pa.int32()), pa.array([united.tobytes()], pa.binary())], schema=out)

    found = np.zeros((bits // part_bits, part_bits // 8), np.uint8)
    for r in hashes.select("h").mapInArrow(mark, schema).groupBy("part").applyInArrow(unite, schema).collect():
        found[r.part] = np.frombuffer(r.bits, np.uint8)
    return found.reshape(-1)


def _routed(docs: DataFrame, items: DataFrame, window: int, doc_id: str, text: str, item_id: str, item_text: str, block_words: int, filter_bits: int, block_docs: int) -> tuple[DataFrame, DataFrame]:
    """(rows, found) for a benchmark of any size: rows has doc, th (hash of the text) and n_words of each document row; found has doc, th, runs (flat) and names of those with matches."""
    body = col(item_text)
    total = items.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = max(1, -(-total // (5 * block_words)))
    own = items.select(F.pmod(F.xxhash64(col(item_id), body), F.lit(blocks)).cast("int").alias("block"), col(item_id).cast("string").alias("name"), body.alias("body"))

    def split(block: list, texts: list) -> dict:
        lists = [fold_words(t) for t in texts]
        return {"block": block, "n": [min(len(w), window) for w in lists], "hs": [window_hashes(w, [min(len(w), window)]).astype(np.int64) if w else [] for w in lists]}

    windows = stored(per_batch(own, ["block", "body"], split, "block int, n int, hs array<long>").where("n > 0").select("n", "block", F.explode("hs").alias("h")).distinct())
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most `window` numbers
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, filter_bits))

    def seen(ids: list, ths: list, texts: list) -> dict:
        lists, bits = [fold_words(t) for t in texts], bitmap.value
        hashes = []
        for w in lists:
            h = window_hashes(w, sizes)
            at = h % np.uint64(filter_bits)
            hashes.append(h[bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1 == 1].astype(np.int64))
        return {"doc": ids, "th": ths, "n_words": [len(w) for w in lists], "hs": hashes}

    known = docs.select(col(doc_id).cast("long").alias("doc"), F.xxhash64(col(text)).alias("th"), col(text).alias("body"))
    rows = stored(per_batch(known, ["doc", "th", "body"], seen, "doc long, th long, n_words long, hs array<long>"))
    asked = rows.select("doc", "th", F.explode("hs").alias("h")).join(windows.select("h", "block").distinct(), "h").select("doc", "th", "block").distinct()
    asked = stored(asked)
    salts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_docs)).cast("int").alias("salts"))
    texts = asked.alias("a").join(known.alias("d"), F.expr("a.th = d.th AND a.doc <=> d.doc")).join(salts, "block").select(
        "block", F.pmod(F.xxhash64("a.th", "a.doc"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "d.doc", "d.th", F.lit(None).cast("string").alias("name"), "body"
    )
    needed = own.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("th"), "name", "body")
    schema = "doc long, th long, runs array<int>, names array<string>"
    out = arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, automaton = None, [], None
        for batch in batches:
            for part in pieces(batch):
                made = []
                for b, salt, kind, doc, th, name, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (b, salt) != at:
                        at, block, automaton = (b, salt), [], None
                    if kind == 0:
                        block.append((name, fold_words(body)))
                        continue
                    if automaton is None:
                        automaton, block = SuffixAutomaton(block, window), []
                    runs, names = automaton.match(fold_words(body))
                    if runs:
                        made.append((doc, th, [x for r in runs for x in r], sorted(names)))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    dealt = needed.unionByName(texts).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
    found = dealt.mapInArrow(match, schema).groupBy("doc", "th").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    return rows.select("doc", "th", "n_words"), found


def _pairs(flat: list[int] | None) -> list[tuple[int, int]]:
    """Merged runs from flat ones."""
    flat = [] if flat is None else [int(x) for x in flat]
    return _merged(list(zip(flat[::2], flat[1::2], strict=True)))


def _small(items: DataFrame, text: str, broadcast_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length(col(text)) + 64)).first()[0] or 0) <= broadcast_bytes


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 50_000, broadcast_bytes: int = 4 << 20, filter_bits: int = 1 << 27, block_docs: int = 20_000) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids), runs (flat word positions start, end)."""

    def report(ids: list, sizes: list, found: list[Found]) -> dict:
        hit = [sum(hi - lo for lo, hi in runs) for runs, _ in found]
        named = [sorted(n) for _, n in found]
        return {
            "doc_id": ids, "n_words": sizes, "n_hit": hit, "n_items": [len(n) for n in named],
            "items_sha256": [hashlib.sha256(",".join(n).encode()).hexdigest() for n in named], "contaminated": [h > 0 for h in hit],
            "items": [",".join(n) for n in named], "runs": [[x for r in runs for x in r] for runs, _ in found],
        }

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string, runs array<int>"
    if _small(items, item_text, broadcast_bytes):
        blocks = _automata(items, item_id, item_text, window, block_words)

        def judge(ids: list, texts: list) -> dict:
            lists = [fold_words(t) for t in texts]
            return report(ids, [len(w) for w in lists], _matches(blocks, lists))

        return per_batch(docs, [doc_id, text], judge, schema)
    rows, found = _routed(docs, items, window, doc_id, text, item_id, item_text, block_words, filter_bits, block_docs)
    both = rows.alias("r").join(found.alias("f"), F.expr("r.th = f.th AND r.doc <=> f.doc"), "left").select("r.doc", "n_words", "runs", "names")
    return per_batch(both, ["doc", "n_words", "runs", "names"], lambda ids, sizes, runs, names: report(ids, sizes, [(_pairs(r), set(n or ())) for r, n in zip(runs, names, strict=True)]), schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_run: int = 10, max_coverage: float = 0.5, least: int = 6, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 50_000, broadcast_bytes: int = 4 << 20, filter_bits: int = 1 << 27, block_docs: int = 20_000) -> DataFrame:
    """The documents without hit runs of max_run words or more, and without documents of which more than max_coverage of the words are hit.

    An item of fewer than max_run words is a run by itself if it has `least` words; shorter ones, which any text may hold
    by chance, are left in it. A removed run takes the characters from its first word to the next word after it. All
    columns stay; n_chars, if there is one, is renewed where the text changed.
    """
    long = min(max_run, least)

    def clean(texts: list, found: list[list[tuple[int, int]]]) -> pd.DataFrame:
        out = []
        for t, runs in zip(texts, found, strict=True):
            if runs and sum(hi - lo for lo, hi in runs) > max_coverage * len(fold_words(t)):
                out.append((False, t))
            else:
                gone = [r for r in runs if r[1] - r[0] >= long]
                out.append((True, without_words(t, gone) if gone else t))
        return pd.DataFrame({"keep": [k for k, _ in out], "body": pd.Series([b for _, b in out], dtype=object)})

    own = docs.select(whole_row(docs).alias("row"), col(text).alias("body"))
    if _small(items, item_text, broadcast_bytes):
        blocks = _automata(items, item_id, item_text, window, block_words)

        @F.pandas_udf("keep boolean, body string")
        def cleaned(texts: pd.Series) -> pd.DataFrame:
            plain = [t if isinstance(t, str) else None for t in texts]
            return clean(plain, [runs for runs, _ in _matches(blocks, list(map(fold_words, plain)))])

        # not deterministic for the optimiser, which would else run it once more for the filter
        made = own.withColumn("made", cleaned.asNondeterministic()("body"))
    else:
        _, found = _routed(docs, items, window, doc_id, text, item_id, item_text, block_words, filter_bits, block_docs)

        @F.pandas_udf("keep boolean, body string")
        def without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
            return clean([t if isinstance(t, str) else None for t in texts], [_pairs(r) for r in runs])

        keyed = docs.select(whole_row(docs).alias("row"), col(text).alias("body"), col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("h"))
        both = keyed.join(found, keyed["id"].eqNullSafe(found["doc"]) & (keyed["h"] == found["th"]), "left")
        made = both.withColumn("made", without.asNondeterministic()("body", "runs"))
    made = made.where("made.keep")
    return with_text(made, docs, text, F.col("made.body"), ~F.col("made.body").eqNullSafe(F.col("body")))


def without_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs and what separates them from the next word."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for lo, hi in runs:
        out.append(text[at : starts[lo]])
        at = starts[hi]
    out.append(text[at:])
    return "".join(out)
