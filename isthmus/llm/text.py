"""Text helpers shared by the training-data operators; all are linear in the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z; every other ASCII byte that is no digit or letter becomes a space. Bytes of non-ASCII characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: The same words on str, for positions: FOLD splits exactly where this pattern does.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names made here can't clash with the user's; `(whole_row(df).alias("row"))` and later `row.*`."""
    return F.struct(*map(col, df.columns))


def with_text(made: DataFrame, docs: DataFrame, text: str, body: Column, changed: Column) -> DataFrame:
    """The columns of docs from the struct `row`, with body as the text; n_chars, if there is one, is renewed where the text changed."""
    kept = F.col("row")
    fields = []
    for name, kind in docs.dtypes:
        own = kept.getField(name)
        if name == text:
            own = body
        elif name == "n_chars":
            own = F.when(changed, F.length(body).cast(kind)).otherwise(own)
        fields.append(own.alias(name))
    return made.select(*fields)


def per_batch(df: DataFrame, columns: list, fn: Callable[..., dict], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Map Arrow batches: fn gets one Python list per column and returns a dict of columns for the schema.

    A batch is cut into pieces of about 8 MB of text so that a few very long texts don't add up. done is called when a
    task ends, so that an idle worker holds nothing that fn has remembered.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for piece in pieces(batch):
                    made = fn(*(c.to_pylist() for c in piece.columns))
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)
        finally:
            if done:
                done()

    # plain names: mapInArrow can't read columns with dots in theirs
    return df.select(*((col(c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(columns))).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string such as ``doc_id long, words array<string>``."""
    return pa.schema([pa.field(name, _TYPES[kind]) for name, kind in (x.split(" ", 1) for x in ddl.split(", "))])
