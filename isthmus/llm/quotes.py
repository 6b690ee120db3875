"""Chat formatting by quotation linking.

Lines that begin with > marks are quotes; the number of marks is their level. Each quoted passage, and each of its lines,
is normalised to lower-case words and hashed, and so are each message's own text, its paragraphs and lines. A quote is
linked to the latest earlier message of the conversation with an equal hash, whole passages before lines. A message
replies to what its first-level quotes are linked to, else to the message before it. `reply_key` orders a conversation
depth-first by replies, earlier replies first; the text keeps no quotes.

No conversation and no hash is gathered in one task: latest-before searches work on buckets of consecutive turns and
carry maxima from bucket to bucket, and keys of replies are extended branch by branch in checkpointed rounds, as many as
branches are nested.

Defined results: a null text is an empty message without quotes; a message that is all quotes has an empty text; a null
turn has no place, hence no parent and no key, and can't be quoted; null conversation ids form one conversation; messages
repeated with one conversation and turn share their parent and key, and replies to either go to that turn; attribution
lines ("... wrote:") right before a quote are dropped with it, however long; very long texts are read whole; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut_lineage, stored
from .text import fold_words, per_batch

MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
#: Verbs that end an attribution line, before its colon.
WROTE = ("wrote", "schrieb", "écrit", "escribió")
WIDTH = 1024


def quote_lines(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of each line."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    return out


def wrote(line: str) -> bool:
    """If the line attributes what follows to someone: a name or more, then one of the verbs and a colon."""
    line = line.rstrip()
    line, verb = line[:-1].rstrip(), line.endswith(":")
    before = next((line[: -len(w)] for w in WROTE if line.endswith(w)), "") if verb else ""
    return bool(before.strip()) and not (before[-1].isalnum() or before[-1] == "_")


def hash_of(text: str) -> int | None:
    words = fold_words(text)
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def parse(text: str | None) -> dict:
    """own text, quoted passages as (level, whole or line, hash), hashes by which the own text can be quoted."""
    lines = quote_lines(text or "")
    own, blocks = [], []
    for k, (level, line) in enumerate(lines):
        if level == 0:
            if not (k + 1 < len(lines) and lines[k + 1][0] and wrote(line)):
                own.append(line)
        elif k and lines[k - 1][0] == level and blocks:
            blocks[-1][1].append(line)
        else:
            blocks.append((level, [line]))
    body = "\n".join(own).strip("\n") if blocks else text or ""
    quotes = []
    for level, part in blocks:
        whole = hash_of("\n".join(part))
        if whole is not None:
            quotes.append((level, 0, whole))
            quotes += [(level, 1, h) for h in map(hash_of, part) if h is not None and h != whole]
    parts = {body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")}
    return {"body": body, "blocks": len(blocks), "level": max((b[0] for b in blocks), default=0), "quotes": quotes, "own": sorted({h for h in map(hash_of, parts) if h is not None})}


def latest_before(rows: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the largest value among rows of equal keys (nulls are equal) whose `at` is smaller. at must not be null.

    Rows of a key are split into buckets of WIDTH consecutive places; only one maximum for each bucket is compared with
    the others. Rows should be distinct, so a bucket of one key is bounded.
    """
    bucket = F.floor(F.col(at) / WIDTH)
    r = rows.withColumn("__b", bucket)
    inside = Window.partitionBy(*keys, "__b").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__in", F.max(value).over(inside))
    tops = rows.groupBy(*keys, bucket.alias("__b")).agg(F.max(value).alias("__top"))
    tops = tops.withColumn("__far", F.max("__top").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__top").where("__far IS NOT NULL")
    same: Column = F.col("r.__b") == F.col("t.__b")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return r.alias("r").join(tops.alias("t"), same, "left").select(*(f"r.{c}" for c in rows.columns), F.greatest("r.__in", "t.__far").alias(name))


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, parent_turn, n_quotes (passages), n_linked (linked hashes), max_level, depth (branches above it), reply_key, text."""

    def split(conv: list, at: list, who: list, texts: list) -> dict:
        made = [parse(t) for t in texts]
        return {
            "conv_id": conv, "turn": at, "role": who, "text": [m["body"] for m in made], "n_quotes": [m["blocks"] for m in made], "max_level": [m["level"] for m in made],
            "levels": [[q[0] for q in m["quotes"]] for m in made], "kinds": [[q[1] for q in m["quotes"]] for m in made], "hashes": [[q[2] for q in m["quotes"]] for m in made], "own": [m["own"] for m in made],
        }

    parsed = per_batch(messages, [conv_id, turn, role, text], split, "conv_id long, turn long, role string, text string, n_quotes long, max_level int, levels array<int>, kinds array<int>, hashes array<long>, own array<long>")
    parsed = cut_lineage(parsed)
    placed = parsed.where("turn IS NOT NULL")
    quotes = placed.where("size(hashes) > 0").select("conv_id", "turn", F.explode(F.arrays_zip("levels", "kinds", "hashes")).alias("q")).select("conv_id", "turn", F.col("q.levels").alias("level"), F.col("q.kinds").alias("kind"), F.col("q.hashes").alias("h"))
    quotes = cut_lineage(quotes.distinct())
    asked = quotes.select("h").distinct()
    owned = placed.select("conv_id", "turn", F.explode("own").alias("h")).join(asked, "h", "left_semi").distinct().select("conv_id", "h", "turn", F.col("turn").alias("source"))
    searched = owned.unionByName(quotes.select("conv_id", "h", "turn").distinct(), allowMissingColumns=True).groupBy("conv_id", "h", "turn").agg(F.max("source").alias("source"))
    latest = latest_before(searched, ["conv_id", "h"], "turn", "source", "original").where("original IS NOT NULL")
    on = lambda a, b, *names: F.expr(" AND ".join(f"{a}.{n} <=> {b}.{n}" for n in names))
    linked = quotes.alias("q").join(latest.alias("l"), on("q", "l", "conv_id", "h", "turn")).select("q.*", "l.original")
    links = linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.when(F.col("level") == 1, F.struct((-F.col("kind")).alias("k"), "original")))["original"].alias("quoted"))
    turns = placed.select("conv_id", "turn").distinct()
    chain = latest_before(turns.withColumn("v", F.col("turn")), ["conv_id"], "turn", "v", "before").drop("v")
    tree = chain.alias("c").join(links.alias("l"), on("c", "l", "conv_id", "turn"), "left").select("c.conv_id", "c.turn", F.coalesce("quoted", "before").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.when(F.col("quoted") != F.col("before"), F.col("c.turn")).alias("branch"))
    # a branch begins where a reply leaves the turn order; each message belongs to the last branch begun
    tree = cut_lineage(latest_before(tree, ["conv_id"], "turn", "branch", "earlier").withColumn("branch", F.coalesce("branch", "earlier")).drop("earlier"))
    keys = _branch_keys(tree)
    nothing = F.array().cast("array<long>")
    full = tree.alias("t").join(keys.alias("k"), on("t", "k", "conv_id", "branch"), "left").select("t.conv_id", "t.turn", "parent_turn", "n_linked", F.concat(F.coalesce("key", nothing), F.array(F.lit(0).cast("long"), F.col("turn"))).alias("key"))
    named = full.withColumn("depth", ((F.size("key") - 2) / 3).cast("int"))
    return parsed.alias("p").join(named.alias("n"), on("p", "n", "conv_id", "turn"), "left").select(
        "p.conv_id", "p.turn", "role", "parent_turn", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("key").alias("reply_key"), "text"
    )


def _branch_keys(tree: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(conv_id, branch, key): key orders branches after what stays on the branch they leave, later leaving points first.

    It is the key of the branch that holds the parent, then 1, minus the parent's turn, and the branch's first turn.
    """
    starts = tree.where("branch = turn").select("conv_id", "branch", F.col("parent_turn").alias("at"))
    above = tree.select("conv_id", F.col("turn").alias("at"), F.col("branch").alias("up"))
    edges = stored(starts.alias("s").join(above.alias("a"), F.expr("s.conv_id <=> a.conv_id AND s.at = a.at")).select("s.conv_id", "branch", "s.at", "up"))
    step = F.array(F.lit(1).cast("long"), -F.col("e.at"), F.col("e.branch"))
    done = stored(edges.alias("e").where("up IS NULL").select("conv_id", "branch", step.alias("key")))
    last = done
    for _ in range(max_rounds):
        if last.isEmpty():
            return done
        last = stored(edges.alias("e").join(last.alias("l"), F.expr("e.conv_id <=> l.conv_id AND e.up = l.branch")).select("e.conv_id", "e.branch", F.concat("l.key", step).alias("key")))
        done = done.union(last)
    raise RuntimeError("branches are nested too deep")
