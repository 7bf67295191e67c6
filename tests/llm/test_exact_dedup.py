import hashlib
import random

from triagelake.llm.exact_dedup import mark_duplicates, one_of_repeats


def test_against_grouping_by_hand(spark, docs_schema):
    rng = random.Random(2)
    texts = [None, "", "a", "a ", "A", "é", "long " * 5000, "hot"]
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(texts), "en", "s", 0) for i in rng.sample(range(10_000), 600)]
    best, size = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        best[t], size[t] = max(i, best.get(t, -1)), size.get(t, 0) + 1
    found = one_of_repeats(mark_duplicates(spark.createDataFrame(rows, docs_schema).repartition(5))).collect()
    assert len(found) == len(rows)
    for r in found:
        t = r["text"] or ""
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[t], size[t], r["doc_id"] == best[t])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "x", "k"), (1, "x", "k"), (None, "y", "k"), (None, "y", "k"), (2, None, "k")]
    marked = one_of_repeats(mark_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string")))
    found = marked.collect()
    assert len(found) == 5 and sum(r["kept"] for r in found) == 3
    assert mark_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_normalisation_is_a_parameter(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string")
    assert {r["keep_id"] for r in mark_duplicates(rows, normalise=F.lower).collect()} == {2}


def test_texts_that_nobody_asks_for_are_not_shuffled_to_their_groups(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, rng.randbytes(1000).hex()) for i in range(2999)]  # a pair of 3000 is not hot: its group comes by shuffle
    spark.createDataFrame([*rows, (2999, rows[0][1])], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    context, broadcast = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        marked = mark_duplicates(spark.read.parquet(str(tmp_path / "docs")))
        before = shuffled()
        assert sum(r["kept"] for r in marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == 2999
        assert 0 < shuffled() - before < 1_000_000  # the texts are 6 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
