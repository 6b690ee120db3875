"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables, and names that clash with those inside or hold dots."""

import random
import time

import corpus_pipeline
import pytest
from test_operators import prose

from isthmus.llm import decontaminate, jaccard, licenses, media, packing, quality, quotes, repeats, secrets, toxicity

NAMES = ["__id", "__th", "__body", "__spans", "__turn", "__own_th", "__cleaned", "__redacted", "row", "id", "th", "h", "body", "made", "left", "spans", "doc", "cid", "runs", "one", "turn", "`odd`", "a b"]
IDS = {"doc_id": "the.id", "text": "the.text"}
TEXT = {"text": "the.text"}
LONG = prose(1, 170_000, 30_000) + " end"
WORDS = prose(2, 80, 3000)
ROWS = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, LONG), (6, WORDS), (6, WORDS), (7, WORDS), (None, WORDS), (None, None), (8, "x" * 200_000), (9, 'token = "0123456789abcdef0123456789"'), (9, "é ü\nß")]


@pytest.fixture(scope="module")
def frame(spark):
    assert len(LONG) > 1_000_000
    rows = [(i, t, None if t is None else len(t), *(f"{n} of {k}" for n in NAMES)) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "`the.id` long, `the.text` string, n_chars int, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(3, 20, 5000)), (None, None), (2, ""), (2, WORDS[:60])], "item_id long, text string")


def reports(spark, bench):
    labels = spark.createDataFrame([(4, 0), (6, 1), (5, 0), (9, 1), (None, 1), (6, None)], "`the.id` long, toxic int")
    return {
        "contamination": lambda f: decontaminate.contamination(f, bench, **IDS),
        "routed contamination": lambda f: decontaminate.contamination(f, bench, **IDS, broadcast_bytes=0, filter_bits=1 << 12),
        "media": lambda f: media.media_features(media.store_media(f, **IDS)),
        "licenses": lambda f: licenses.scan_licenses(f, **IDS),
        "quality": lambda f: quality.score_quality(f, quality.fit_quality(f, **IDS), **IDS),
        "secrets": lambda f: secrets.scan_secrets(f, **IDS),
        "repeats": lambda f: repeats.repeats_report(f, **IDS),
        "jaccard": lambda f: jaccard.jaccard_join(f, **IDS),
        "toxicity": lambda f: toxicity.score_toxicity(f, toxicity.fit_toxicity(f, labels, **IDS, lang="a b"), **IDS),
    }


def test_reports_have_a_row_for_each(spark, frame, bench):
    for name, run in reports(spark, bench).items():
        began = time.time()
        got = run(frame).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS), name
        same = [tuple(r) for r in got if r.doc_id == 6]
        assert same[0] == same[1], name
        assert run(frame.limit(0)).count() == 0, name
        assert time.time() - began < 200, name


def test_packing_has_all_pieces(frame):
    got = packing.pack(frame, most=256, group_pieces=50, **IDS).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ROWS} and sum(r.doc_id == 6 for r in got) == 2 * sum(r.doc_id == 7 for r in got)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256 and packing.pack(frame.limit(0), **IDS).count() == 0


def kept(df, changed=()):
    """Rows by their marker column; the user's columns are as they were."""
    out = {}
    for r in df.collect():
        k = int(r["row"].split(" of ")[1])
        assert all(r[n] == f"{n} of {k}" for n in NAMES)
        assert r["the.id"] == ROWS[k][0] and (k in changed or r["the.text"] == ROWS[k][1]) and r["n_chars"] == (None if r["the.text"] is None else len(r["the.text"]))
        out[k] = r["the.text"]
    return out


def test_filters_keep_the_users_columns(spark, frame, bench):
    everything = set(range(len(ROWS)))
    for size in (1 << 20, 0):
        got = decontaminate.decontaminate(frame, bench, **IDS, broadcast_bytes=size, filter_bits=1 << 12)
        assert got.columns == frame.columns and set(kept(got, {5, 6, 7, 8})) == everything
    got = jaccard.drop_near_duplicates(frame, **IDS)
    assert got.columns == frame.columns
    left = kept(got)
    assert len({5, 6, 7, 8} & set(left)) == 1 and left.keys() | {5, 6, 7, 8} == everything  # one of the copies, all wordless ones
    got = repeats.remove_repeats(frame, **IDS)
    assert got.columns == frame.columns and set(kept(got, {5, 6, 7, 8})) == everything
    got = secrets.redact_secrets(frame, **TEXT)
    assert got.columns == frame.columns and "0123456789abcdef" not in kept(got, {10, 11})[11]
    got = quality.keep_good(frame, quality.fit_quality(frame, **IDS), **TEXT)
    assert got.columns == frame.columns and set(kept(got)) <= everything
    for f in (lambda x: decontaminate.decontaminate(x, bench, **IDS), lambda x: jaccard.drop_near_duplicates(x, **IDS), lambda x: repeats.remove_repeats(x, **IDS), lambda x: secrets.redact_secrets(x, **TEXT)):
        assert f(frame.limit(0)).count() == 0


def test_stages(spark, tmp_path):
    bodies = [(i, t, "en", "s", None if t is None else len(t), "mine") for i, t in ROWS]
    frame = spark.createDataFrame(bodies, "doc_id long, text string, lang string, source string, n_chars long, __th string").repartition(3).cache()
    spark.createDataFrame([(1, prose(3, 20, 5000)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert got.columns == frame.columns, name
        rows = got.collect()
        assert rows and all(name == "packing" or r["__th"] == "mine" for r in rows), name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
    frame.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_links(talk):
    """Parent of each turn by the definition, and all turns depth-first."""
    made = [quotes.parse(t) for t in talk]
    parent = []
    for k, m in enumerate(made):
        found = [(-kind, max(j for j in range(k) if h in made[j]["own"])) for level, kind, h in m["quotes"] if level == 1 and any(h in made[j]["own"] for j in range(k))]
        parent.append(max(found)[1] if found else k - 1 if k else None)
    order = []

    def walk(k):
        order.append(k)
        for j in range(k + 1, len(talk)):
            if parent[j] == k:
                walk(j)

    walk(0)
    return parent, order


def test_quotes_by_definition(spark):
    rng = random.Random(12)
    talks = []
    for c in range(6):
        talk = []
        for k in range(25):
            own = "\n\n".join("\n".join(prose(1000 * c + 40 * k + 7 * p + q, rng.randrange(3, 7), 5000) for q in range(rng.randrange(1, 3))) for p in range(rng.randrange(1, 3)))
            parts = []
            for _ in range(rng.choice([0, 0, 1, 1, 2]) if k else 0):
                source = rng.choice(talk)
                part = rng.choice([source, *source.split("\n\n"), *source.split("\n")])
                parts.append(rng.choice(["", "On some day a very long name " * 12 + "wrote:\n"]) + "\n".join("> " + line for line in part.split("\n")))
            talk.append("\n".join([*parts, own]))
        talks.append(talk)
    rows = [(c, k, "u", t) for c, talk in enumerate(talks) for k, t in enumerate(talk)]
    rng.shuffle(rows)
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c, talk in enumerate(talks):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
        parent, order = brute_links(talk)
        assert [r.parent_turn for r in mine] == parent
        assert [r.turn for r in sorted(mine, key=lambda r: r.reply_key)] == order
        assert not any(line.startswith(">") or "wrote:" in line for r in mine for line in r.text.split("\n"))
