"""Learned operators: accuracy on the driver's tables, many classes, clashing names, repeated rows and long texts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bpe, langid, queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language(spark, SF).where("held_out").join(docs, "doc_id").where("lang is not null")
    r = got.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert r.n > 3000
    assert r.right >= 0.98


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op5_toxicity(spark, SF).where("held_out").join(labels, "doc_id").where("toxic is not null").select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) >= 0.8
    assert sum(false) / len(false) <= 0.01


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    rows = []
    for k in range(230):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(rng.choices(own, k=30)), f"l{k:03d}") for i in range(7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert len(model.languages) == 230
    got = langid.predict(table, model, keep=("lang",)).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert set(got.lang_pred) == set(got.lang)


def test_few_rows_hold_nothing_out(spark):
    table = spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of to", "en")], "doc_id long, text string, lang string")
    model = langid.train(table)
    assert (model.temperature, model.threshold) == (1.0, 0.0)
    assert [r.lang_pred for r in langid.predict(table, model).orderBy("doc_id").collect()] == ["de", "en"]


def test_kept_columns_of_any_name(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "vile" if i % 3 == 0 else "cc"], k=20)) + ".", ["x", "y"][i % 2], 7.5, i % 3 == 0, "d") for i in range(60)]
    rows += [(100, None, "x", 7.5, False, "d"), (101, rows[0][1], "x", 7.5, True, "d"), (101, rows[0][1], "x", 7.5, True, "d"), (102, "aa " * 400_000 + "vile", "y", 7.5, True, "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, toxic boolean, `a.b` string")
    keep = ("doc_id", "score", "a.b", "text")
    labels = table.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id < 100")
    found = {
        "score": langid.predict(table, langid.train(table.where("doc_id < 100")), keep=keep),
        "predicted": toxicity.score(table, toxicity.train(table, labels), keep=keep),
        "n_tokens": bpe.digests(table, queries.public_tokenizers.path(queries.VOCABULARY), queries.public_tokenizers.PATTERN, keep=(*keep, "lang")),
    }
    for column, df in found.items():
        got = df.collect()
        assert column in df.columns
        assert "a.b" in df.columns
        assert len(got) == len(rows)
        assert {r["kept_score" if "kept_score" in df.columns else "score"] for r in got} == {7.5}
        twice = [tuple(r) for r in got if r.doc_id == 101]
        assert len(set(twice)) == 1
    assert toxicity.locate(table, toxicity.train(table, labels), keep=keep).columns[:4] == ["doc_id", "kept_score", "a.b", "text"]
