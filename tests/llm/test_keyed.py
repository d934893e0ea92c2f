"""Rows picked by keys: right rows, and texts without a key are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import docs
from wordloom.llm import keyed, simhash
from wordloom.session import stored


@pytest.mark.parametrize("n_keys, max_bitmaps", [(0, 4096), (40, 4096), (3000, 4096), (3000, 1)])
def test_rows_with_and_without_keys(spark, n_keys, max_bitmaps):
    texts = [f"text {i // 2}" if i % 3 else (f"text {i}",) for i in range(6000)] + [None, "", (None,), ("",)]
    rows = docs(spark, texts).unionByName(docs(spark, texts[:200])).unionByName(docs(spark, ["another text"] * 200))
    rng = random.Random(n_keys)
    picked = rng.sample(range(6000), n_keys) + [6000, 6003] * bool(n_keys)
    own = {(None if isinstance(texts[i], tuple) else i, texts[i][0] if isinstance(texts[i], tuple) else texts[i]) for i in picked}
    keys = spark.createDataFrame([(i, t, f"v{i}") for i, t in own], "doc_id long, text string, value string")
    keys = stored(keys.select("doc_id", F.xxhash64("text").alias("text_hash"), "value"), "test-keys")
    key = lambda found: sorted(map(repr, found))
    everything = [tuple(r) for r in rows.collect()]
    got = keyed.without(rows, keys, max_bitmaps=max_bitmaps)
    assert got.columns == rows.columns
    assert key(map(tuple, got.collect())) == key(r for r in everything if r[:2] not in own)
    maybe, others = keyed.with_values(rows, keys, "value", max_bitmaps=max_bitmaps)
    maybe, others = [tuple(r) for r in maybe.collect()], [tuple(r) for r in others.collect()]
    assert key([r[:-1] for r in maybe] + others) == key(everything)
    assert all(r[-1] == (f"v{r[0]}" if r[:2] in own else None) for r in maybe)
    assert sum(r[:2] in own for r in maybe) == sum(r[:2] in own for r in everything)
    assert len(others) > 0.8 * (len(everything) - len(own)) or max_bitmaps == 1


def test_rows_that_repeat_a_doc_id_are_judged_by_their_own_text(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "aa bb cc dd"
    table = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda *rows: sorted(map(tuple, simhash.keep_one(table(*rows)).collect()))
    assert found((3, b), (5, a), (5, b), (7, a)) == [(3, b), (5, a)]
    # of doc_id 5 the text with the smaller letters is doc_id 3's
    assert found((3, b), (5, a), (5, a), (5, b), (7, a)) == [(3, b), (5, a)]
    assert found((5, a + " x y z"), (5, b), (7, a + " x y z")) == [(5, b)]


def shuffled(spark, df, folder):
    """Writes ``df()``; bytes that each stage of the session has shuffled so far, by the stage's number."""
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    df().write.parquet(folder)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination", "personal_data"])
def test_texts_without_a_key_are_not_shuffled(spark, tmp_path, stage):
    """With keys that are too many to broadcast."""
    rng = random.Random(7)
    passage = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew strong purple tea in the old stone tower."
    texts = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(300)) for _ in range(620)]
    texts[600:] = [f"{t} {passage} a@b.cd" for t in texts[600:]]
    texts += texts[30:50]
    rows = stored(docs(spark, texts).select("doc_id", "text"), "test-docs")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = shuffled(spark, lambda: spark.range(1), f"file://{tmp_path}/none")
        moved = shuffled(spark, lambda: dict(corpus_pipeline.STAGES)[stage](spark, rows, f"file://{tmp_path}"), f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {r.doc_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    tagged = {n: t.replace("a@b.cd", "[EMAIL]") for n, t in enumerate(texts)}
    assert got == {"near_duplicates": dict(enumerate(texts[:620])), "decontamination": {n: t for n, t in enumerate(texts) if not 600 <= n < 620}, "personal_data": tagged}[stage]
    assert sum(n for s, n in moved.items() if s > max(last)) < 0.3 * sum(map(len, texts))
