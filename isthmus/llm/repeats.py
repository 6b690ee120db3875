"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (at . ! ? and line ends) of lower-case words. A sentence of more than `longest` words is cut
further, after each word whose hash is the least of some `gap` consecutive words of it, so that a passage is cut alike
wherever it begins and no part has more than `gap` words. A run is the shortest one of at least `sentences` sentences
(or parts) and `words` words that begins at a sentence, or that ends at one; so every sentence of a repeated passage that
is long enough lies in a run inside it. Of a passage at most `longest` words at each end are not cut alike, so with the
given lengths every passage of 50 words holds a run. Runs are hashed to 128 bits and joined globally. The first run of a
hash is that with the smallest (doc_id, text hash, position); sentences covered by any other are removed.

Halves of hashes are counted first, then only runs whose half occurs again are looked at. Counts and firsts are
pre-aggregated before their shuffle and the joins' large sides can be split, so a run that a third of all documents share
doesn't gather in a task.

Defined results: null texts and texts too short for a run have nothing to remove; null ids come first; rows repeated with
one id and text are one document and fare alike; a passage repeated within a text goes as well, a very long word is a word
like others, very long texts are read whole; an empty table gives no rows; other columns, whatever their names, pass
through `remove_repeats` unread.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .text import WORD, arrow_schema, col, fold_words, pieces, whole_row, with_text

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\n?")
HALF, TOP = 1 << 63, 1 << 64


def cuts_of(hashes: list[int], gap: int) -> list[int]:
    """Places after the words whose hash is the least (of equal ones the last) of some `gap` consecutive ones."""
    out, start, n = [], 0, len(hashes)
    while start + gap <= n:
        window = hashes[start : start + gap]
        least = min(window)
        p = start + gap - 1 - window[::-1].index(least)
        out.append(p + 1)
        j = start + gap
        while j < min(p + gap, n):  # windows that still hold p: only a word as small as it can take its place
            if hashes[j] <= least:
                p, least = j, hashes[j]
                out.append(p + 1)
            j += 1
        start = p + 1
    return out


def sentences_of(text: str, longest: int, gap: int) -> tuple[list[int], list[int], list[int], bytes]:
    """Starts, ends and word counts of the sentences with words, and their 64-bit hashes one after another."""
    starts, ends, counts, hashes = [], [], [], []
    for m in SENTENCE.finditer(text):
        words = fold_words(m.group())
        if not words:
            if ends:
                ends[-1] = m.end()
        elif len(words) <= longest:
            starts.append(m.start()), ends.append(m.end()), counts.append(len(words))
            hashes.append(xxhash.xxh3_64_digest(b" ".join(words)))
        else:
            places = [w.start() for w in WORD.finditer(text, m.start(), m.end())]
            places[0] = m.start()
            cuts = [0, *(k for k in cuts_of(list(map(zlib.crc32, words)), gap) if k < len(words))]
            for lo, hi in zip(cuts, [*cuts[1:], len(words)], strict=True):
                starts.append(places[lo]), ends.append(places[hi] if hi < len(words) else m.end()), counts.append(hi - lo)
                hashes.append(xxhash.xxh3_64_digest(b" ".join(words[lo:hi])))
    return starts, ends, counts, b"".join(hashes)


def runs_of(counts: list[int], sentences: int, words: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the shortest run from each sentence on, and of the shortest up to each; each run once."""
    n, hi, total, forward = len(counts), 0, 0, []
    for lo in range(n):
        while hi < n and (total < words or hi - lo < sentences):
            total += counts[hi]
            hi += 1
        if total < words or hi - lo < sentences:
            break
        forward.append((lo, hi))
        total -= counts[lo]
    yield from forward
    # up to each sentence: the latest start that is early enough; the same run as above unless another start shares its end
    lo, total, ends = 0, 0, {hi: lo for lo, hi in forward}
    for hi in range(1, n + 1):
        total += counts[hi - 1]
        while hi - lo > sentences and total - counts[lo] >= words:
            total -= counts[lo]
            lo += 1
        if hi - lo >= sentences and total >= words and ends.get(hi) != lo:
            yield lo, hi


def repeated_spans(docs: DataFrame, sentences: int = 3, words: int = 20, longest: int = 12, gap: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), spans (start << 32 | end of runs that aren't the first) and sources (ids with their firsts), for documents that have any."""
    schema = "k1 long, k2 long, doc_id long, th long, pos long"
    out = arrow_schema(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                k1, k2, ids, ths, pos = [], [], [], [], []
                for doc, th, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not body:
                        continue
                    starts, ends, counts, hashes = sentences_of(body, longest, gap)
                    before = len(k1)
                    for lo, hi in runs_of(counts, sentences, words):
                        h = xxhash.xxh3_128_intdigest(hashes[8 * lo : 8 * hi])
                        k1.append((h >> 64) - HALF), k2.append(h % TOP - HALF)
                        pos.append(starts[lo] << 32 | ends[hi - 1])
                    ids += [doc] * (len(k1) - before)
                    ths += [th] * (len(k1) - before)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k1, k2, ids, ths, pos)], schema=out)

    runs = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("th"), col(text).alias("body")).mapInArrow(hashed, schema)
    # stored, so that each join below has exchanges of its own, whose partitions of a hot hash Spark can split
    often = stored(runs.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"))
    shared = stored(runs.join(often, "k1", "left_semi"))
    firsts = stored(shared.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first")))
    later = shared.join(firsts, ["k1", "k2"]).where("NOT (doc_id <=> first.doc_id AND th = first.th AND pos = first.pos)")
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("spans"), F.collect_set("first.doc_id").alias("sources"))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(spans or ()):
        lo, hi = p >> 32, p & 0xFFFFFFFF
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def repeats_report(docs: DataFrame, sentences: int = 3, words: int = 20, longest: int = 12, gap: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_chars, n_removed (characters), removed (start-end, comma-joined), sources (sorted ids of documents that keep the passages)."""
    spans = repeated_spans(docs, sentences, words, longest, gap, doc_id, text)
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("th"), F.coalesce(F.length(col(text)), F.lit(0)).cast("long").alias("n_chars"))
    both = rows.alias("r").join(spans.alias("s"), F.expr("r.doc_id <=> s.doc_id AND r.th = s.th"), "left").select("r.doc_id", "n_chars", "spans", F.array_sort(F.coalesce("sources", F.array().cast("array<long>"))).alias("sources"))
    schema = "doc_id long, n_chars long, n_removed long, removed string, sources array<long>"
    out = arrow_schema(schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [merged(s) for s in batch["spans"].to_pylist()]
            made = (batch["doc_id"], batch["n_chars"], [sum(hi - lo for lo, hi in r) for r in ranges], [",".join(f"{lo}-{hi}" for lo, hi in r) for r in ranges], batch["sources"])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)

    return both.mapInArrow(report, schema)


def remove_repeats(docs: DataFrame, sentences: int = 3, words: int = 20, longest: int = 12, gap: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the sentences of repeated runs; all columns stay, n_chars, if there is one, is renewed where the text changed."""
    spans = repeated_spans(docs, sentences, words, longest, gap, doc_id, text).drop("sources")

    @F.pandas_udf("string")
    def without(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, lists, strict=True):
            if s is not None and len(s):
                kept, at = [], 0
                for lo, hi in merged([int(x) for x in s]):
                    kept.append(t[at:lo])
                    at = hi
                t = "".join([*kept, t[at:]])
            out.append(t if isinstance(t, str) else None)
        return pd.Series(out, dtype=object)

    own = docs.select(whole_row(docs).alias("row"), col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("h"), col(text).alias("body"))
    both = own.join(spans, own["id"].eqNullSafe(spans["doc_id"]) & (own["h"] == spans["th"]), "left")
    both = both.withColumn("left", F.when(F.col("spans").isNotNull(), without("body", "spans")).otherwise(F.col("body")))
    return with_text(both, docs, text, F.col("left"), F.col("spans").isNotNull())
