"""Secret scan with multipart credential linking.

Base kinds are found everywhere: *assign* (a secret word, an assignment sign, a value of 6 or more), *access* (AKIA and
capitals or digits, 20 or more) and *hex* (24 or more lower-case hex digits). Weak parts - *id* (a run of 20 or more
capitals and digits), *secret* (a run of 20 or more with capitals, small letters and digits and high entropy) and
*endpoint* (a URL) - mean little alone. They are joined by interval within a scope, which is a paragraph of the text and
at most `reach` characters away, and are reported only when complementary parts co-occur: an id with a secret, a secret
with an id, an endpoint with both. Base spans count as parts as well: access as an id, assign and hex as secrets.

Defined results: a null text is empty and has no spans; a weak part that overlaps a base span isn't reported; touching
but not overlapping spans stay apart; every row is scanned by itself, whole, however long, in time linear in the text up
to sorting and binary searches; repeated rows give repeated results; an empty table gives no rows; other columns, whatever
their names, pass through `redact_secrets` unread.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import col, per_batch, whole_row, with_text

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A maximal run that can hold an access identifier, a hex secret or a weak part; {n,} finds the same runs as + with a test of the length.
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
URL = re.compile(r"https?://[^\s\"'<>]+")
WEAK_ID = re.compile(r"(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{20,}")
BLANK = re.compile(r"\n[ \t]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if "passw" in low or "secret" in low or "token" in low or "api" in low:
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in LONG.finditer(text):
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, run.start(), run.end())]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out, key=_place)


def _place(s: Span) -> tuple[int, int]:
    return s[0], ORDER[s[2]]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values())


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that overlap no base span."""
    out: list[Span] = []
    for m in LONG.finditer(text):
        s = m.group()
        if WEAK_ID.fullmatch(s):
            out.append((m.start(), m.end(), "id"))
        elif any(c.isupper() for c in s) and any(c.islower() for c in s) and any(c.isdigit() for c in s) and _entropy(s) >= 3.5:
            out.append((m.start(), m.end(), "secret"))
    if "://" in text:
        out += [(m.start(), m.end(), "endpoint") for m in URL.finditer(text)]
    ends, taken = 0, []
    for lo, hi, _ in base:
        if taken and lo < taken[-1][1]:
            taken[-1][1] = max(hi, taken[-1][1])
        else:
            taken.append([lo, hi])
    starts, ends = [t[0] for t in taken], [t[1] for t in taken]
    return [s for s in out if bisect_right(ends, s[0]) == bisect_left(starts, s[1])]


def linked(text: str, base: list[Span], weak: list[Span], reach: int) -> list[Span]:
    """The weak parts with their complements in scope: sorted interval starts, one search each."""
    if not weak:
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]
    ids, secrets = [], []
    for lo, hi, kind in base + weak:
        if kind in ("access", "id"):
            ids.append((lo, hi))
        elif kind != "endpoint":
            secrets.append((lo, hi))
    tables = []
    for spans in (ids, secrets):
        spans.sort()
        tables.append(([s[0] for s in spans], list(accumulate((s[1] for s in spans), max))))

    def near(span: Span, table: tuple) -> bool:
        """If a span of the table overlaps the scope: of those that begin before its end, the one that ends last."""
        starts, furthest = table
        k = bisect_left(cuts, span[0])
        low = max(span[0] - reach, cuts[k - 1] if k else 0)
        high = min(span[1] + reach, cuts[k] if k < len(cuts) else len(text))
        k = bisect_left(starts, high)
        return k > 0 and furthest[k - 1] > low

    need = {"id": (1,), "secret": (0,), "endpoint": (0, 1)}
    return [s for s in weak if all(near(s, tables[t]) for t in need[s[2]])]


def find_spans(text: str, reach: int = 300) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and kind."""
    base = base_spans(text)
    return base, sorted(base + linked(text, base, weak_parts(text, base), reach), key=_place)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


def scan_secrets(docs: DataFrame, reach: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts and a hash of the base spans, and all spans as kind:start:end (code points, end exclusive)."""

    def scan(ids: list, texts: list) -> dict:
        found = [find_spans(t or "", reach) for t in texts]
        counts = [Counter(s[2] for s in base) for base, _ in found]
        return {"doc_id": ids} | {f"n_{k}": [c[k] for c in counts] for k in KINDS[:3]} | {"base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], "spans": [_joined(s) for _, s in found]}

    return per_batch(docs, [doc_id, text], scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, reach: int = 300, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """The documents with `mark` in place of every span but endpoints; overlapping spans become one mark. All columns stay; n_chars, if there is one, is renewed where the text changed."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [s for s in find_spans(t, reach)[1] if s[2] != "endpoint"], mark) if isinstance(t, str) else None for t in texts], dtype=object)

    made = docs.select(whole_row(docs).alias("row"), col(text).alias("body")).withColumn("left", redacted("body"))
    return with_text(made, docs, text, F.col("left"), ~F.col("left").eqNullSafe(F.col("body")))


def without_spans(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for lo, hi, _ in spans:
        if lo >= at:
            out += [text[at:lo], mark]
        at = max(at, hi)
    return "".join([*out, text[at:]])
