"""Later decoder records count, also where they have no words."""

from triagelake.plans import queries_exchange


def test_a_later_record_without_words_counts(spark, tmp_path):
    # p is (31 * doc_id + 17 * pos) % 100 / 100 and below 0.3 a word is wrong: 0.12 is the only word of 8352, 0.93 and 0.10 are those of 3, 0.31 and 0.48 those of 1.
    spark.createDataFrame([(8352, "avec."), (3, "Right wrong"), (1, "two words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["unit_id"]: (r["n_words"], r["text"], r["total_p"]) for r in queries_exchange.QUERIES["sv_decoder_words"](spark, str(tmp_path)).collect()}
    assert found == {"3": (1, "right", 0.93), "1": (2, "two words", 0.79)}
