"""Best-fit packing into token sequences by the sum-of-squares rule.

Each document becomes its token ids and an end id; only what is longer than a sequence is cut, into whole sequences and a
rest. The pieces are dealt evenly over groups of about `group_pieces`, whatever the size of the corpus, and each group is
packed on its own, longest piece first: a piece goes where the sum of squared counts of open bins per residual gap becomes
smallest. The number of groups comes from the number of documents and of their bytes (a sequence for every 4 bytes a
token), so a few very long documents make more groups, not larger ones. Only piece lengths and checksums are shuffled,
never texts or ids.

Defined results: a null or empty text is one piece that holds the end id; equal or repeated rows are packed each; equal
lengths are placed in order of (doc_id, piece, checksum), null ids last; very long texts are tokenised whole; an empty
table has no pieces; other columns aren't read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import arrow_schema, col, pieces

TOKENIZERS_DIR = "/opt/tokenizers"

#: Chunks of these characters (no white space, NFC as they stand, lower case of one character) can be split apart here; others go to the tokenizer.
PLAIN = regex.compile("[!-~\xa1-\xac\xae-\u012f\u0131-\u017f]+")
#: Fixed value: how this tokenizer splits a lower-cased text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package that holds them names it, or else their folder."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join(TOKENIZERS_DIR, name)


def _byte_letters() -> dict[int, str]:
    """Letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    """Little-endian 32-bit ids of texts, by chunks between spaces and by words within; both are remembered.

    Exact for this tokenizer: it drops white space and never joins across it, folds case and encodes each word alone.
    The memory is only a cache, emptied when it is full, and long chunks aren't kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.code = [struct.pack("<I", i) for i in range(self.whole.get_vocab_size())]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.code[t.id] for t in self.model.tokenize(spelt)])
            if len(word) <= CACHE_CHARS:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join([self._word(w) for w in WORDS.findall(chunk.lower())])
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Empty the memory, so that an idle worker holds none."""
        self.chunks.clear()
        self.words.clear()

    def ids(self, text: str) -> bytes:
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        known, out = self.chunks, []
        for c in text.replace("\n", " ").replace("\t", " ").split(" "):
            if (ids := known.get(c)) is None:
                ids = self._chunk(c)
                if len(c) <= CACHE_CHARS:
                    known[c] = ids
            out.append(ids)
        return b"".join(out)


_LOADED: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, most: int, groups: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the group that the piece is dealt to, in turn within each task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, group long"
    out, end = arrow_schema(schema), np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        encode = own.ids
        turn = TaskContext.get().partitionId() * 7919
        try:
            for part in (part for batch in batches for part in pieces(batch)):
                rows = []
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(body or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        cut_ids = ids[at : at + 4 * most]
                        rows.append((doc, k, at // 4, len(cut_ids) // 4, zlib.crc32(cut_ids), turn % groups))
                        turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        finally:
            own.forget()

    return docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("body")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    With N(g) open bins of gap g, putting s into a gap g changes the sum of squares by 2 (N(g-s) - N(g) + 1), by
    1 - 2 N(s) if it fills the bin, and by 2 N(most-s) + 1 in a new bin. Ties go to the smaller gap, a new bin last.
    """
    count = np.zeros(most + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        g = most
        if s < most:
            open_ = count[s:most]
            change = np.where(open_ > 0, 2 * (count[: most - s] - open_ + 1), never)
            if open_[0]:
                change[0] -= 1
            k = int(change.argmin())
            if change[k] <= 2 * count[most - s] + 1:
                g = s + k
        if g == most:
            b, bins = bins, bins + 1
        else:
            count[g] -= 1
            b = stacks[g].pop()
        if g > s:
            count[g - s] += 1
            stacks[g - s].append(b)
        where[i], offset[i] = b, most - g
    return where, offset


def pack(docs: DataFrame, most: int = 2048, vocabulary: str = "word_bpe_49k.json", group_pieces: int = 8192, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset. path: of the vocabulary file, if it isn't the public one of that name."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(col(text))), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(size.n + size.bytes // (4 * most)) // group_pieces))
    made = token_pieces(docs, path or tokenizer_path(vocabulary), most, groups, end_id, doc_id, text)

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = sum_of_squares(part["length"].to_numpy(), most)
        part = part.append_column("sequence_id", pa.array((part["group"].to_numpy() << 40) + where))
        return part.append_column("offset", pa.array(offset)).drop_columns(["group"])

    return made.groupBy("group").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
