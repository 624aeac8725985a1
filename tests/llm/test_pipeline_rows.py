"""The pipeline on odd rows and empty tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'en' and n_chars between 1500 and 4000").orderBy("doc_id").first()
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \n\t", "en", "s", 3), (9003, "12 34 !", "en", "s", 7), (9004, good.text, None, None, None), (9005, good.text, "en", "s", 1), (9005, good.text, "en", "s", 1), (None, good.text, "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(odd, FIELDS)).selectExpr("*", "1 as n_words", "'x' as lang_pred", "2 as component_id", "'y' as sketch", "3 as bucket").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = got.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == columns
        ids[name] = [r.doc_id for r in got.select("doc_id").collect()]
    assert not {9000, 9001, 9002, 9003} & set(ids["language"]) and ids["language"].count(9005) == 2 and {9004, None} <= set(ids["language"])
    assert 9004 in ids["quality"] and ids["quality"].count(9005) == 2
    kept = ids["near_duplicates"]
    assert good.doc_id in kept and 9004 not in kept and 9005 not in kept and None in kept and len(set(kept)) == len(kept)
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
