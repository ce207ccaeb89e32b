"""The corpus pipeline over ``documents``: filter, near duplicates, passages, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; :func:`run` writes what a stage returns as Parquet into the folder that
driver and executors share, and reads it again. All but the last return the
columns of ``documents``, ``n_chars`` brought up to date with the text.

No stage joins by doc_id but the labels of the toxicity stage: rows travel
through the operators whole. So repeated ids are rows each, and a row without an
id is filtered, grouped, cut and mixed by its text like any other.

Defined results: a null text is kept by the toxicity filter, linked with
nothing, has no passages, and drops out of the mix, which takes no words of it;
a text that the cut of passages empties goes, one that was without words before
stays; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, mixing, neardup, suffixdedup, toxicity
from chronoweave.llm.common import WORD_CLASS, drop_table, table
from chronoweave.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__scored"))
    scored = toxicity.score(rows, model, text="__scored", keep=("__row",))
    return scored.where("predicted = 0").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, of the least id; texts without words all stay."""
    return neardup.representatives(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that also stand elsewhere; emptied texts go."""
    others = F.struct(F.col("text").isNull().alias("__null"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    got = suffixdedup.repeated_passages(docs.select("doc_id", "text", others.alias("__row")), with_text=True, keep=("__row",))
    kept = got.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD_CLASS))
    text = F.when(~F.col("__row")["__null"], F.col("kept_text"))
    return kept.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col("__row")[c].alias(c) for c in docs.columns])


def _renewed(column: str, text):
    """A column of ``documents`` after its text changed."""
    if column == "text":
        return text.alias("text")
    return F.length(text).cast("long").alias("n_chars") if column == "n_chars" else F.col(f"`{column}`")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by the weights of :class:`mixing.Mix`; repeated documents are repeated rows."""
    mixed = mixing.mixed_texts(docs)
    return mixed.select(*[_renewed(c, F.col("text")) for c in docs.columns])


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids, their number, and the digests of ids and decoded bytes."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.encoded(docs, path, pattern, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", cut_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: No stage but the mixing's quotas can be put in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written and read again."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = table(spark, docs)
            if old:
                drop_table(spark, old)
            old = path
    return docs
