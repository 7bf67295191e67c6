"""Queries on tables: scans, joins, grouping levels, sets, splits and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from triagelake.operators import bootstrap, dealing, splits
from triagelake.plans.registry import DEALT, Registry, drawn_sql, rounded
from triagelake.plans.views import LEX, UNITS, UTT, WORDS, lexicon, table, units, utterances, words
from triagelake.sources import records
from triagelake.streaming import live

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add


@query("src_parquet_cols", "", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'N'")
def src_parquet_cols(spark, d):
    return table(spark, d, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_parquet_shards", "", "SELECT c_custkey, c_name, CAST(file_row_number AS BIGINT) AS row FROM (SELECT c_custkey, c_name, row_number() OVER () - 1 AS file_row_number FROM customer)")
def src_parquet_shards(spark, d):
    return records.read_shards(spark, f"{d}/customer.parquet", ["c_custkey", "c_name"]).select("c_custkey", "c_name", "row")


@query("join_words_units", WORDS + ", " + UNITS, "SELECT ev, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(correct), 6) AS correct FROM words JOIN units USING (unit_id) GROUP BY ev")
def join_words_units(spark, d):
    return rounded(words(spark, d).join(units(spark, d), "unit_id").groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("correct").alias("correct")))


@query("join_scores_units", UNITS, "SELECT u.unit_id, round(u.r, 6) AS r, n_chars FROM units u JOIN documents d ON d.doc_id = u.unit_id")
def join_scores_units(spark, d):
    return rounded(units(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "n_chars"), "unit_id").select("unit_id", "r", "n_chars"))


@query("join_manifest_outputs", "", "SELECT 'missing' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'found', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_manifest_outputs(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit("found").alias("kind")), "doc_id", "left")
    return joined.groupBy(F.coalesce("kind", F.lit("missing")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("join_second_opinion", "", "SELECT d.doc_id, coalesce(l.quality, -1) AS second FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_second_opinion(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("second"))


@query("join_semi_train", "", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_semi_train(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("join_group_intersection", "", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def join_group_intersection(spark, d):
    docs = table(spark, d, "documents").select("source", "lang")
    return docs.filter("lang = 'en'").select("source").distinct().join(docs.filter("lang = 'de'"), "source", "left_semi").join(docs.filter("lang = 'fr'"), "source", "left_semi")


@query("join_lexicon_counts", LEX + ", " + WORDS, "SELECT term, any_value(n) AS n_lexicon, count(*) AS n_corpus FROM lex JOIN words ON token = term GROUP BY term")
def join_lexicon_counts(spark, d):
    counted = words(spark, d).groupBy(F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("n_corpus"))
    return lexicon(spark, d).withColumnRenamed("n", "n_lexicon").join(counted, "term")


@query("flt_anti_done", "", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt_anti_done(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("flt_duration_train", UTT, """SELECT consultation, idx, CASE WHEN role = 'user' THEN 'patient' ELSE 'other' END AS audio_source FROM utt WHERE "end" - start <= 30 AND text <> ''""")
def flt_duration_train(spark, d):
    kept = utterances(spark, d).filter((F.col("end") - F.col("start") <= 30) & (F.col("text") != ""))
    return kept.select("consultation", "idx", F.when(F.col("role") == "user", "patient").otherwise("other").alias("audio_source"))


@query("flt_set_key", UNITS, "SELECT ev || '_' || CASE WHEN crit = 1 THEN 'crit' ELSE 'plain' END || '_' || CASE WHEN tuning THEN 'tune' ELSE 'test' END AS set_key, count(*) AS n FROM units GROUP BY 1")
def flt_set_key(spark, d):
    key = F.concat_ws("_", "ev", F.when(F.col("crit") == 1, "crit").otherwise("plain"), F.when(F.col("tuning"), "tune").otherwise("test"))
    return units(spark, d).groupBy(key.alias("set_key")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_entity_table", "", """SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'type:' || l_returnflag WHEN grouping(l_linestatus) = 0 THEN 'context:' || l_linestatus ELSE 'all' END AS level, count(*) AS n, round(avg(l_discount), 4) AS accuracy
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (), (l_linestatus))""")
def agg_entity_table(spark, d):
    grouped = table(spark, d, "lineitem").groupingSets([["l_returnflag"], [], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(
        F.when(F.grouping("l_returnflag") == 0, F.concat(F.lit("type:"), "l_returnflag")).when(F.grouping("l_linestatus") == 0, F.concat(F.lit("context:"), "l_linestatus")).otherwise("all").alias("level"), F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("accuracy")
    )
    return rounded(grouped.select("level", "n", "accuracy"), 4)


@query("agg_count_distinct", "", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_supps FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_supps"))


@query("agg_bincount", "", "SELECT d.doc_id, count(l.doc_id) AS n, CAST(coalesce(sum(l.toxic), 0) AS BIGINT) AS weighted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id")
def agg_bincount(spark, d):
    counted = table(spark, d, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("weighted"))
    return table(spark, d, "documents").select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weighted", F.lit(0)).alias("weighted"))


@query("agg_group_lists", UTT, "SELECT consultation, list(role ORDER BY idx) AS roles FROM utt GROUP BY consultation")
def agg_group_lists(spark, d):
    return utterances(spark, d).groupBy("consultation").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "role"))), lambda x: x["role"]).alias("roles"))


@query("agg_counter_mode", "", """SELECT c_nationkey, c_mktsegment AS mode, n, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM (
  SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL)) WHERE k = 1""")
def agg_counter_mode(spark, d):
    counted = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    line = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "first")
    best = counted.withColumns({"k": F.row_number().over(line), "total": F.sum("n").over(Window.partitionBy("c_nationkey"))}).filter("k = 1")
    return best.select("c_nationkey", F.col("c_mktsegment").alias("mode"), "n", "total")


@query("agg_prf", UNITS, "SELECT ev, round(tp / nullif(h, 0), 6) AS \"precision\", round(tp / nullif(n, 0), 6) AS recall, round(2 * tp / nullif(h + n, 0), 6) AS f1 FROM (SELECT ev, sum(least(errors, n_ref))::DOUBLE AS tp, sum(errors)::DOUBLE AS h, sum(n_ref)::DOUBLE AS n FROM units GROUP BY ev)")
def agg_prf(spark, d):
    s = units(spark, d).groupBy("ev").agg(F.sum(F.least("errors", "n_ref")).cast("double").alias("tp"), F.sum("errors").cast("double").alias("h"), F.sum("n_ref").cast("double").alias("n"))
    return rounded(s.select("ev", F.try_divide("tp", "h").alias("precision"), F.try_divide("tp", "n").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("h") + F.col("n")).alias("f1")))


@query("agg_wins", UNITS, "SELECT count(*) FILTER (a < b) AS wins_a, count(*) FILTER (a > b) AS wins_b, count(*) FILTER (a = b) AS ties FROM (SELECT group_id, sum(CASE WHEN y = 1 THEN errors ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN errors ELSE 0 END) AS b FROM units GROUP BY group_id)")
def agg_wins(spark, d):
    side = lambda k: F.sum(F.when(F.col("y") == k, F.col("errors")).otherwise(0))
    g = units(spark, d).groupBy("group_id").agg(side(1).alias("a"), side(0).alias("b"))
    return g.agg(F.count(F.when(F.col("a") < F.col("b"), 1)).alias("wins_a"), F.count(F.when(F.col("a") > F.col("b"), 1)).alias("wins_b"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("ties"))


@query("agg_compare_pairs", UNITS, "SELECT group_id, round(sum(CASE WHEN y = 1 THEN errors END) / sum(CASE WHEN y = 1 THEN n_ref END)::DOUBLE, 6) AS wer_1, round(sum(CASE WHEN y = 0 THEN errors END) / sum(CASE WHEN y = 0 THEN n_ref END)::DOUBLE, 6) AS wer_0 FROM units GROUP BY group_id")
def agg_compare_pairs(spark, d):
    p = units(spark, d).groupBy("group_id").pivot("y", [0, 1]).agg(F.sum("errors").alias("e"), F.sum("n_ref").alias("n"))
    return rounded(p.select("group_id", (F.col("1_e") / F.col("1_n")).alias("wer_1"), (F.col("0_e") / F.col("0_n")).alias("wer_0")))


_DIST = """1 - list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / nullif(sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 0)"""
_SEM = f"sd AS (SELECT a.label, CAST(a.vec_id // 25 AS VARCHAR) AS group_id, {_DIST} AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), " + drawn_sql(
    "sr", "sd", "label", 4, "", {"s": "sum(dist)", "f": "sum(CAST(dist > 0.1 AS INT))", "k": "count(dist)"}
)


@query("agg_semdist", _SEM, """SELECT label, p.m AS mean_dist, p.f AS share_far, round(quantile_cont(r.s / r.k, 0.025), 5) AS mean_dist_lo, round(quantile_cont(r.s / r.k, 0.975), 5) AS mean_dist_hi,
  round(quantile_cont(r.f / r.k::DOUBLE, 0.025), 5) AS share_far_lo, round(quantile_cont(r.f / r.k::DOUBLE, 0.975), 5) AS share_far_hi
  FROM sr r JOIN (SELECT label, round(avg(dist), 5) AS m, round(avg(CAST(dist > 0.1 AS INT)), 5) AS f FROM sd GROUP BY label) p USING (label) GROUP BY label, p.m, p.f""")
def agg_semdist(spark, d):
    """1 - cosine of each vector and the next one, by the label of the first: mean and share above 0.1, with intervals by resampling blocks of vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("c")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dist = 1 - dot("v", "c") / F.nullif(F.sqrt(dot("v", "v")) * F.sqrt(dot("c", "c")), F.lit(0.0))
    rows = both.select("label", F.floor(F.col("vec_id") / 25).alias("group_id"), dist.alias("dist"))
    stats = {"mean_dist": (F.col("dist"), F.when(F.col("dist").isNotNull(), 1)), "share_far": ((F.col("dist") > 0.1).cast("int"), F.when(F.col("dist").isNotNull(), 1))}
    return rounded(bootstrap.interval(rows, ["label"], bootstrap.resampled_ratios(rows, ["label"], stats, 200, 4), stats), 5)


_SPLIT = "sp AS (SELECT doc_id, lang, source, text, CASE WHEN doc_id % 10 < 6 THEN 'calibration' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM documents)"
_RANK = "CASE split WHEN 'test' THEN 0 WHEN 'calibration' THEN 1 ELSE 2 END"


def _split(spark: SparkSession, d: str):
    m = F.col("doc_id") % 10
    return table(spark, d, "documents").select("doc_id", "text", "source", F.when(m < 6, "calibration").when(m < 8, "validation").otherwise("test").alias("split"))


@query("sp_leak_drop", _SPLIT, f"SELECT doc_id, split FROM (SELECT *, min({_RANK}) OVER (PARTITION BY text) AS best FROM sp) WHERE {_RANK} = best")
def sp_leak_drop(spark, d):
    return splits.drop_leaks(_split(spark, d).withColumn("key", F.sha2("text", 256)).drop("text"), ["key"]).select("doc_id", "split")


@query("sp_leak_check", _SPLIT, "SELECT source, count(DISTINCT split) AS n_splits FROM sp GROUP BY source HAVING count(DISTINCT split) > 1")
def sp_leak_check(spark, d):
    return splits.leaks(_split(spark, d), "source")


@query("sp_leak_check_texts", _SPLIT, "SELECT sha256(text) AS text_key, count(DISTINCT split) AS n_splits FROM sp WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT split) > 1")
def sp_leak_check_texts(spark, d):
    return splits.leaks(_split(spark, d).filter("text IS NOT NULL").withColumn("text_key", F.sha2("text", 256)), "text_key")


@query("sp_group_split", "RECURSIVE g AS (SELECT source AS grp, count(*) AS n FROM documents GROUP BY source)" + DEALT.format(zeros="[0, 0, 0]", times="[1, 3, 3]"), "SELECT grp AS source, ['calibration', 'validation', 'test'][bin] AS split FROM one WHERE i > 0")
def sp_group_split(spark, d):
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return dealing.dealt(sizes, "source", "n", {"calibration": 3, "validation": 1, "test": 1}).withColumnRenamed("bin", "split")


@query("sp_group_split_users", "RECURSIVE g AS (SELECT CAST(user_id AS VARCHAR) AS grp, count(*) AS n FROM events GROUP BY user_id)" + DEALT.format(zeros="[0, 0, 0]", times="[2, 7, 14]"), "SELECT ['train', 'validation', 'test'][bin] AS split, count(*) AS n, sum(n)::BIGINT AS n_events, min(grp) AS first_user FROM one JOIN g USING (grp) WHERE i > 0 GROUP BY bin")
def sp_group_split_users(spark, d):
    """Events by split of their users: many groups, many of the same size."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"))
    split = dealing.with_bins(e, "user", {"train": 7, "validation": 2, "test": 1}, "split")
    return split.groupBy("split").agg(F.countDistinct("user").alias("n"), F.count(F.lit(1)).alias("n_events"), F.min("user").alias("first_user"))


@query("sp_stratified_pick")
def sp_stratified_pick(spark, d):
    return splits.stratified_pick(table(spark, d, "documents"), "lang", "source", 3, 7)


@query("sp_fold_replace", "", "SELECT doc_id, quality, 'main' AS origin FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 1 - quality, 'fold' FROM labels WHERE doc_id % 5 = 0")
def sp_fold_replace(spark, d):
    main = table(spark, d, "labels").select("doc_id", "quality", F.lit("main").alias("origin"))
    better = table(spark, d, "labels").filter("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).cast(main.schema["quality"].dataType).alias("quality"), F.lit("fold").alias("origin"))
    return splits.replace_rows(main, better, "doc_id")


@query("so_union_all", "", "SELECT doc_id, NULL::INT AS quality, lang FROM documents UNION ALL SELECT doc_id, CAST(quality AS INT), NULL FROM labels")
def so_union_all(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").unionByName(table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), allowMissingColumns=True).select("doc_id", "quality", "lang")


@query("so_difference", "", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def so_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("so_intersect", "", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def so_intersect(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("so_distinct_last", "", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def so_distinct_last(spark, d):
    return splits.keep_last(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("so_distinct_entities", "", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def so_distinct_entities(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()


@query("sort_multi", "", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey) AS place FROM customer")
def sort_multi(spark, d):
    # Places are counted within nations first, so no task sorts the table.
    c = table(spark, d, "customer")
    before = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("c_nationkey")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.withColumn("own", own).join(F.broadcast(before), "c_nationkey").select("c_custkey", (F.col("before") + F.col("own")).alias("place"))


@query("sv_live_turns", UTT, "SELECT count(*) AS n, count(DISTINCT consultation) AS n_consultations, round(max(\"end\"), 6) AS decoded_until FROM utt")
def sv_live_turns(spark, d):
    # The turns go through a file stream and its event log; what a late subscriber replays is the result.
    from triagelake.streaming.live import live_turns, replay

    base = records.scratch_folder(spark)
    utterances(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    running = live_turns(stream, "live", f"{base}/log", f"{base}/checkpoint")
    running.processAllAvailable()
    running.stop()
    turns = replay(spark, f"{base}/log").filter("event = 'turn'").select(F.from_json("data", "consultation long, idx long, end double").alias("t")).select("t.*")
    return rounded(turns.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("consultation").alias("n_consultations"), F.max("end").alias("decoded_until")))


@query("sv_event_windows", "", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def sv_event_windows(spark, d):
    found = live.event_counts(table(spark, d, "events"))
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)
