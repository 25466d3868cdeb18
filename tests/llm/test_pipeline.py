"""The pipeline on the smallest documents: its stages in order, and what each does to planted rows."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.conftest import SF


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    line = " ".join(f"shared{i}" for i in range(40))
    planted = [(9001, None, None, "s", 0), (9002, "123 456", "en", "s", 7), (9003, docs.first().text, "en", "s", 1), (9004, f"Call +1 (276) 555-5999 now. {line} alpha beta gamma", "en", "s", 1), (9005, f"Other words stand here first. {line} delta", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen, out = [], docs
    for name, stage in cp.STAGES:
        made = stage(spark, out, SF)
        made.write.parquet(f"file://{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "language":
            assert not {9001, 9002} & ids and {9003, 9004, 9005} <= ids
        if name == "near_duplicates":
            assert 9003 not in ids and {9004, 9005} <= ids
        if name == "repeats":
            assert "shared20" not in out.where("doc_id = 9005").first().text
        if name == "personal_data":
            text = out.where("doc_id = 9004").first().text
            assert "[PHONE]" in text and "555" not in text and "alpha beta gamma" in text
    assert [n for n, _ in seen] == ["language", "near_duplicates", "repeats", "personal_data", "packing"]
    assert out.agg(F.count_distinct("doc_id")).first()[0] == seen[3][1]


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, own_hash int"
    text = "the house and the water are here for all of us today and tomorrow again"
    odd = [(None, text + " x", "en", None, 1, "k", 1), (None, None, None, None, None, None, None), (1, "", "en", "s", 0, "k", 1), (2, "  ", None, "s", 2, "k", 1), (3, text, "en", "s", 1, "k", 1), (3, text, "en", "s", 1, "k", 1), (4, text.upper(), None, "s", 1, "k", 1), (5, "les maisons sont ici " * 400, "fr", "s", 1, "k", 1), (6, "das haus und wasser nicht ohne uns " * 3, "de", "s", 1, "k", 1)]
    spark.createDataFrame(odd, schema).repartition(2).write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    got = cp.run(spark, f"file://{tmp_path}/odd").collect()
    ids = [r.doc_id for r in got]
    assert set(ids) <= {None, 3, 4, 5, 6} and len({3, 4} & set(ids)) == 1 and {5, 6} <= set(ids)
    assert all(r.length > 0 and r.offset + r.length <= 4096 for r in got)
    assert cp.run(spark, f"file://{tmp_path}/none").count() == 0
