"""Each pipeline stage on its own input, and all together."""

import corpus_pipeline
from test_operators import prose


def test_stages(spark, tmp_path):
    item = prose(1, 40, 900)
    clean = [f"The way of the land is as it was in {prose(k, 60, 9000)} and the rest is for all." for k in range(40)]
    texts = [*clean, clean[3], clean[5] + " " + item, f"The way of the land is as it was in {prose(99, 60, 9000)}" + ' token = "0123456789abcdef0123456789"', " | ".join(f"c{j}" for j in range(80)), None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        left = {r.doc_id: r.text for r in docs.collect()}
        assert set(range(40)) <= set(left) and all(left[i] == clean[i] for i in range(40))
        if k == 0:
            assert 43 not in left
        elif k == 1:
            assert 40 not in left and 41 in left
        elif k == 2:
            assert item not in left[41] and left[41].startswith(clean[5])
        else:
            assert "0123456789abcdef" not in left[42]
    want = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
