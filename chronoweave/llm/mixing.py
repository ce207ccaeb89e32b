"""Mixing sources to target weights, with DataFrame operators alone.

A source's documents are dealt into shards by a seeded hash and laid out, in a
seeded order, as one line of words a shard. Sainte-Lague apportionment gives
blocks of equal size to sources by the highest quotients ``weight / (2 k - 1)``,
and each source's blocks to its shards by the highest quotients of their sizes;
no source or shard gets more than ``max_repeats`` times its words. Such a block
has ``block_words`` words, or fewer where a small source's target would be less
than ``least_blocks`` of them, down to one word. Of its quota a shard takes
whole passes over its line first and spreads the rest evenly, in runs of
``block_words`` words from a seeded start, which has a closed form: no row a
block is ever made. The last run is cut where the quota ends, so a shard gives
exactly its quota.

The quotients are not enumerated. Two levels of the exact water-filling, a few
blocks below and above the total, enclose the divisor; only the quotients
between them, three a party at most, are ranked.

Sources and shards are tables of sums. Everything that is one row a document
is dealt by (source, shard), and a hot source has as many shards as its size
asks for. Spark broadcasts the table of sources only where its measured size
is below the session's threshold, and joins it by shuffle otherwise. The
windows over all sources are one task's, a row a source.

Defined results: null or empty text has no words and takes none; a null source
is a source of its own, the last; repeated rows, and different texts under one
id, are documents each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, WS_CLASS, table


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix: ``weights`` are dealt to sources in code point order, repeating."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    max_repeats: int = 2
    block_words: int = 32
    least_blocks: int = 16
    docs_per_shard: int = 2048
    seed: str = "mix"


def count_words(text: Column) -> Column:
    """Number of runs of other than space and 0x09-0x0D; 0 for null."""
    trimmed = F.regexp_replace(text, f"^{WS_CLASS}+", "")
    return F.coalesce(F.length(F.regexp_replace(trimmed, f"{WORD_CLASS}+{WS_CLASS}*", "a")), F.lit(0)).cast("long")


def _hash(seed: str, key: Column) -> Column:
    """60 bits of the MD5 of seed and key, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _level(parties: DataFrame, by: list[str], total: Column, name: str) -> DataFrame:
    """Add ``name``: the level L at which sum(min(cap, w * L)) over a group is ``total``.

    Null where the caps do not reach the total: then every party gets its cap.
    """
    order = Window.partitionBy(*by).orderBy("__ratio", "__pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*by)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # the parties below the level are a prefix by cap / weight; the first that
    # its cap does not bind sets the level
    mine = F.when(F.col("w") > 0, left / weight)
    return parties.withColumn("__mine", mine).withColumn(
        name, F.max(F.when(F.col("__mine") <= F.col("__ratio"), F.col("__mine"))).over(everyone)
    )


def sainte_lague(parties: DataFrame, by: list[str], total: str) -> DataFrame:
    """Add ``quota``: whole units for each party of a group by the highest quotients.

    ``parties`` has ``w`` (weight >= 0), ``cap`` (whole units) and ``pos`` (the
    order that settles ties); ``total`` names the group's units. Capped parties
    leave their further quotients to the rest.
    """
    everyone = Window.partitionBy(*by)
    p = parties.withColumns({
        "__pos": F.col("pos"),
        "__ratio": F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))),
        "__total": F.least(F.col(total), F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).over(everyone)),
        "__m": F.count("*").over(everyone),
    })
    p = _level(p, by, F.greatest(F.col("__total") - F.col("__m"), F.lit(0)), "__low")
    p = _level(p, by, F.col("__total") + F.col("__m"), "__high")

    def units(level: str, without: Column) -> Column:
        n = F.least(F.col("cap").cast("double"), F.floor(F.col("w") * F.col(level) + 0.5).cast("double"))
        return F.when(F.col("w") <= 0, 0).when(F.col(level).isNull(), without).otherwise(n).cast("long")

    p = p.withColumn("__base", units("__low", F.col("cap"))).withColumn("__top", units("__high", F.col("cap")))
    p = p.withColumn("__left", F.col("__total") - F.sum("__base").over(everyone))
    k = F.explode_outer(F.when(F.col("__top") > F.col("__base"), F.sequence(F.col("__base") + 1, F.col("__top"))))
    q = p.select("*", k.alias("__k"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("w") / (2 * F.col("__k") - 1)).desc_nulls_last(), "__pos", "__k"))
    q = q.withColumn("__won", (F.col("__k").isNotNull() & (rank <= F.col("__left"))).cast("long"))
    keys = [c for c in parties.columns]
    won = q.groupBy(*[F.col(c) for c in keys], "__base").agg(F.sum("__won").alias("__won"))
    return won.select(*keys, (F.col("__base") + F.col("__won")).alias("quota"))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: n_docs, source_size, weight, target (words) and pos.

    Targets share ``mix.share`` of all words by weight; a target stops at
    ``mix.max_repeats`` times its source's size and its excess goes to the rest.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    pos = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    s = by_source.withColumn("pos", pos.cast("long")).withColumns({
        "w": F.element_at(weights, ((F.col("pos") - 1) % len(mix.weights) + 1).cast("int")),
        "cap": (F.col("source_size") * mix.max_repeats).cast("double"),
        "__pos": F.col("pos"),
    })
    s = s.withColumn("__ratio", F.col("cap") / F.col("w"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(mix.share))
    s = _level(s.withColumn("__total", total), [], F.col("__total"), "__level")
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("__level"), F.col("cap")))
    return s.select("source", "n_docs", "source_size", "pos", F.col("w").alias("weight"), target.alias("target"))


def _taken_before(x: Column, block: int) -> Column:
    """Words of the picked runs among the first ``x`` words of a shard's line, ``rest_words`` at most."""
    return F.least(F.col("rest_words"), _picked_before(x, block))


def _picked_before(x: Column, block: int) -> Column:
    """The same without the quota's end.

    Run j of n is picked when floor((j + 1 + u) r / n) exceeds floor((j + u) r / n),
    so the first j runs hold floor((j + u) r / n) - floor(u r / n) picked ones.
    """
    n, r, u = (F.col(c) for c in ("blocks", "rest", "start"))
    j = F.floor(x / block)

    def picked(k: Column) -> Column:
        return F.floor((k + u) * r / n) - F.floor(u * r / n)

    return picked(j) * block + (picked(j + 1) - picked(j)) * (x - j * block)


def mix_quotas(docs: DataFrame, mix: Mix = Mix(), text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document with what the mix takes of it.

    Columns: doc_id, source, ``keep``; size, source_size, target; passes (whole
    copies), taken (words, repeats counted), and the line geometry (line_start,
    blocks, rest, rest_words, start) from which :func:`mixed_texts` cuts the partial copy.
    """
    own = [c for c in keep if c not in (doc_id, source)]
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *[F.col(c).alias(f"__keep_{c}") for c in own], count_words(F.col(text)).alias("size"))
    spark = docs.sparkSession
    counted, _ = table(spark, sizes.select("doc_id", "source", "size"))
    least = F.min(F.when(F.col("source_size") > 0, F.col("target"))).over(Window.partitionBy())
    unit = F.greatest(F.lit(1), F.least(F.lit(mix.block_words), F.floor(least / mix.least_blocks))).cast("long")
    targets, _ = table(spark, source_targets(counted, mix).withColumn("__unit", unit))
    if not own:
        sizes = counted
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / mix.docs_per_shard))
    small = targets.select(F.col("source").alias("__source"), "source_size", "target", "weight", F.col("pos").alias("__source_pos"), shards.alias("__shards"), "__unit")

    def deal(rows: DataFrame) -> DataFrame:
        out = rows.join(small, rows["source"].eqNullSafe(small["__source"])).drop("__source")
        return out.withColumn("shard", _hash(mix.seed + "/shard/", F.col("doc_id")) % F.col("__shards"))

    by_shard = deal(counted).groupBy("source", "shard", "source_size", "target", "weight", "__source_pos", "__unit").agg(F.sum("size").alias("shard_size"))
    by_shard = by_shard.withColumn("cap", F.floor(F.col("shard_size") * mix.max_repeats / F.col("__unit")))
    per_source = by_shard.groupBy("source", "weight", "__source_pos", "__unit").agg(F.sum("cap").alias("cap"), F.max("target").alias("__target"))
    total = F.round(F.sum("__target").over(Window.partitionBy()) / F.col("__unit")).cast("long")
    parties = per_source.select("source", F.col("weight").alias("w"), "cap", F.col("__source_pos").alias("pos"), total.alias("units"))
    quotas, _ = table(spark, sainte_lague(parties, [], "units"))
    quotas = quotas.select(F.col("source").alias("__source"), F.col("quota").alias("__source_quota"))
    members = by_shard.join(quotas, by_shard.source.eqNullSafe(quotas["__source"])).select(
        "source", "shard", F.col("shard_size").cast("double").alias("w"), "cap", F.col("shard").alias("pos"), "__source_quota", "shard_size", "__unit"
    )
    got = sainte_lague(members, ["source"], "__source_quota")
    start = (_hash(mix.seed + "/start/", F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("shard").cast("string"))) % 1000003) / F.lit(1000003.0)
    size, words = F.col("shard_size"), F.col("quota") * F.col("__unit")
    got = got.select(
        F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.ceil(size / mix.block_words).alias("blocks"),
        F.when(size > 0, F.floor(words / size)).otherwise(0).alias("passes"),
        F.when(size > 0, words % size).otherwise(0).alias("rest_words"),
        # the last run of a line may be short; so many picked ones hold the words all the same
        ((-size) % mix.block_words + mix.block_words).alias("__short"), start.alias("start"),
    )
    short = F.col("__short") % mix.block_words
    runs = F.when(F.col("rest_words") > 0, F.least(F.col("blocks"), F.ceil((F.col("rest_words") + short) / mix.block_words))).otherwise(0)
    got, _ = table(spark, got.withColumn("rest", runs).drop("__short"))

    # different texts under one id, of one size, keep their order from run to run
    tie = [F.xxhash64(*[F.col(f"__keep_{c}") for c in own])] if own else []
    line = Window.partitionBy("source", "shard").orderBy(_hash(mix.seed + "/order/", F.col("doc_id")), "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, 0)
    laid = deal(sizes).withColumn("line_start", F.sum("size").over(line) - F.col("size"))
    out = laid.join(got, laid.source.eqNullSafe(got["__source"]) & (laid.shard == got["__shard"]))
    part = F.when((F.col("rest") > 0) & (F.col("size") > 0), _taken_before(F.col("line_start") + F.col("size"), mix.block_words) - _taken_before(F.col("line_start"), mix.block_words)).otherwise(0)
    return out.select(
        "doc_id", "source", *[F.col(f"__keep_{c}").alias(c) for c in own], "size", "source_size", "target", "shard",
        F.col("passes").cast("long").alias("passes"), (F.col("passes") * F.col("size") + part).cast("long").alias("taken"),
        "line_start", F.col("blocks").cast("long").alias("blocks"), F.col("rest").cast("long").alias("rest"), F.col("rest_words").cast("long").alias("rest_words"), "start",
    )


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus, with the columns of ``docs``.

    A document comes out once for each whole pass, and once more with the words
    of its picked blocks (white space kept) where those are part of it.
    """
    cols = docs.columns
    at = {c: f"__d{i}" for i, c in enumerate(cols)}  # the input's names may be any, ours among them
    taken = mix_quotas(docs.toDF(*at.values()), mix, at[text], at[doc_id], at[source], keep=tuple(at.values()))
    whole = at[text]
    words = F.regexp_extract_all(F.regexp_replace(F.col(whole), f"^{WS_CLASS}+", ""), F.lit(f"{WORD_CLASS}+{WS_CLASS}*"), 0)
    run = lambda i: F.floor((F.col("line_start") + i) / mix.block_words)
    n, r, u = (F.col(c) for c in ("blocks", "rest", "start"))
    in_run = F.filter(words, lambda _, i: F.floor((run(i) + 1 + u) * r / n) > F.floor((run(i) + u) * r / n))
    # the quota ends in few documents; only there each word is held against its end
    before = lambda i: _taken_before(F.col("line_start") + i, mix.block_words)
    in_quota = F.filter(words, lambda _, i: before(i + 1) > before(i))
    ends_later = _picked_before(F.col("line_start") + F.col("size"), mix.block_words) <= F.col("rest_words")
    chosen = F.when(ends_later, in_run).otherwise(in_quota)
    part = F.when(F.col("taken") > F.col("passes") * F.col("size"), F.array_join(chosen, ""))
    copies = F.concat(
        F.when((F.col("passes") > 0) & (F.col("size") > 0), F.array_repeat(F.col(whole), F.col("passes").cast("int"))).otherwise(F.array().cast("array<string>")),
        F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>")),
    )
    out = taken.withColumn("__copy", F.explode(copies))
    pick = {doc_id: "doc_id", source: "source", text: "__copy"}
    return out.select(*[F.col(pick.get(c, at[c])).alias(c) for c in cols])
