"""Quality rules with DataFrame operators alone.

Plain rules first: words, symbols, repeated lines and repeated five-word
windows. What passes them is judged by a hashed n-gram log-likelihood ratio:
two multinomials over ``buckets`` hashed unigrams and bigrams, one of the raw
corpus and one of the trusted target, each counted over all its documents: no
sample is drawn from either. A document's verdict is
its mean log ratio a feature against one threshold for all, so every document is
judged alike and on its own. The threshold comes from the target: each half of
it is scored by the ratios that the other half gives, and the threshold lies
``margin`` below the ``quantile`` of those scores that pass the base rules.

On the driver meet the count vectors, ``buckets`` numbers each, whatever the
corpus, and the target's scores up to the quantile, 0.1 % of its documents.
Words are hashed once, where they are read; measures and features then lie in
the shared folder, for the counts, the threshold and the result to read. Counts
are summed before the shuffle. The trusted ids meet the ids of the documents
alone; what marks the features' rows is a bit a document, in words that are
broadcast for up to ``BROADCAST_ROWS`` documents and shuffled for more.

Defined results: null or empty text has no words and fails the base rules; a
document of one word has one feature; an empty target or corpus gives a ratio
of zero everywhere; a target that leaves a half empty, or of which no document
passes the base rules, sets no threshold; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, WS_CLASS, q, table

#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"

#: Documents up to which the target's marks, two words of 64 bits for 64 documents, are broadcast.
BROADCAST_ROWS = 2**26


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    buckets: int = 8192
    smoothing: float = 1.0
    #: A document is kept from this quantile of the target's own mean log ratios
    #: less the margin on. Texts of the raw corpus's own kind lie near 0 and
    #: texts of another make-up below.
    quantile: float = 0.001
    margin: float = 0.05


def words(text: Column) -> Column:
    """The runs of other than space and 0x09-0x0D, in order; empty for null."""
    trimmed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WS_CLASS}+"))


def _repeat_words(sorted_spans: str, width: int) -> Column:
    """Words that lie in windows of ``width`` words found twice or more.

    ``sorted_spans``: (64-bit hash, position) of the windows, sorted, so that
    equal ones are neighbours; the positions that have an equal are then laid
    over the words.
    """
    by_hash = F.col(sorted_spans)

    def shared(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(by_hash, i - 1)["h"] == x["h"])
        after = (i + 1 < F.size(by_hash)) & (F.get(by_hash, i + 1)["h"] == x["h"])
        return before | after

    at = F.array_sort(F.transform(F.filter(by_hash, shared), lambda x: x["p"]))
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))

    def cover(acc: Column, p: Column) -> Column:
        return F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))

    return F.aggregate(at, start, cover, lambda acc: acc["n"].cast("long"))


def measures(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, features.

    ``features``: the buckets of the text's unigrams and bigrams.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    kept = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    one = docs.select(
        *kept,
        words(F.col(text)).alias("__words"),
        F.length(F.regexp_replace(t, f"{WS_CLASS}+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    names = [f"__keep_{i}" for i in range(len(keep))]
    two = one.select(
        *names, "word_chars", "n_symbols",
        F.size("__words").alias("__n"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    w = rules.window
    spans = F.when(
        F.col("__n") >= w,
        F.transform(F.sequence(F.lit(0), F.col("__n") - w), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(w)])),
    )
    three = two.select(
        *names, "word_chars", "n_symbols", "__n", "n_dup_lines", spans.alias("__spans"),
        _features("__h", rules.buckets).alias("features"),
    )
    repeated = F.col("__spans").isNotNull() & (F.size(F.array_distinct("__spans")) < F.size("__spans"))
    four = three.select(
        *names, "word_chars", "n_symbols", "__n", "n_dup_lines", "features",
        F.when(repeated, F.sort_array(F.transform("__spans", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("__by_hash"),
    )
    rep = F.when(F.col("__by_hash").isNull(), F.lit(0).cast("long")).otherwise(_repeat_words("__by_hash", w))
    n = F.col("n_words")
    five = four.select(
        *[F.col(x).alias(c) for x, c in zip(names, keep, strict=True)], F.col("__n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"), "features"
    )
    failed = (n < rules.min_words) | (F.col("n_repeat_words") * 100 > n * rules.max_repeat_percent)
    return five.withColumn("base_failed", failed)


def _features(hashes: str, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of an array of word hashes."""
    m = F.lit(buckets)
    last = F.size(hashes) - 2
    pairs = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), m).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(hashes, lambda x: F.pmod(x, m).cast("int")), pairs)


def mark_target(measured: DataFrame, trusted: DataFrame) -> DataFrame:
    """``measured`` (with its own ``__id`` and unique ``__row``) and ``__half``: 0 or 1, by the id, if ``__id`` is in ``trusted``, else null.

    Ids are matched without the features. A word of 64 bits a half tells which
    of 64 successive rows belong to it, so that what meets the features is small.
    """
    ids = trusted.where("__trusted_id is not null").distinct()
    ids = ids.withColumn("__half", F.pmod(F.xxhash64("__trusted_id", F.lit("half")), F.lit(2)).cast("int"))
    hits = measured.select("__id", "__row").join(ids, F.col("__id") == F.col("__trusted_id"))
    word, place = F.expr("shiftright(__row, 6)"), F.expr("cast(__row & 63 as int)")
    bit = F.expr("shiftleft(1L, cast(__row & 63 as int))")
    bits = hits.groupBy(word.alias("__word")).agg(*[F.bit_or(F.when(F.col("__half") == k, bit).otherwise(0)).alias(f"__in_{k}") for k in (0, 1)])
    bits = F.broadcast(bits) if measured.count() <= BROADCAST_ROWS else bits
    joined = measured.withColumn("__word", word).join(bits, "__word", "left")
    half = F.when(F.getbit("__in_0", place) == 1, 0).when(F.getbit("__in_1", place) == 1, 1)
    return joined.withColumn("__half", half).drop("__word", "__in_0", "__in_1")


def bucket_counts(marked: DataFrame) -> DataFrame:
    """x (bucket), n (all texts), n_0 and n_1 (texts of each ``__half`` of the target), over all documents."""
    flat = marked.select("__half", F.explode("features").alias("x"))
    counts = flat.groupBy("x", "__half").agg(F.count("*").alias("n")).groupBy("x")
    return counts.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("__half") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in (0, 1)])


def log_ratios(n: list[int], t: list[int], rules: Rules) -> list[float]:
    """ln(target / raw) of each bucket, smoothed, from the counts of the raw corpus and the target."""
    a, raw, target = rules.smoothing, sum(n), sum(t)
    if not raw or not target:
        return [0.0] * rules.buckets
    base = math.log((raw + a * rules.buckets) / (target + a * rules.buckets))
    return [math.log((y + a) / (x + a)) + base for x, y in zip(n, t, strict=True)]


def _mean_ratio(ratios: list[float]) -> Column:
    """Mean of ``ratios`` over ``features``; zero where there are none."""
    vector = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate("features", F.lit(0.0), lambda acc, b: acc + F.get(vector, b))
    return F.when(F.size("features") > 0, total / F.size("features")).otherwise(F.lit(0.0))


def target_threshold(target: DataFrame, n: list[int], halves: list[list[int]], rules: Rules) -> float:
    """``rules.margin`` below the ``rules.quantile`` of the target's scores, each half scored by the other's ratios.

    ``target``: its rows of :func:`mark_target`. The quantile is exact: only the
    scores up to its rank are sorted together.
    """
    passed = target.where("not base_failed")
    count = passed.count()
    if not all(map(sum, halves)) or not count:
        return -math.inf
    other = [log_ratios(n, t, rules) for t in reversed(halves)]
    score = F.when(F.col("__half") == 0, _mean_ratio(other[0])).otherwise(_mean_ratio(other[1]))
    at = rules.quantile * (count - 1)
    near = [r["s"] for r in passed.select(score.alias("s")).orderBy("s").offset(int(at)).limit(2).collect()]
    return near[0] + (at - int(at)) * (near[-1] - near[0]) - rules.margin


def judge(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: its measures, ``score`` (mean log ratio) and ``kept``.

    ``trusted``: ids (column ``doc_id``) of the target's documents; all of them count.
    """
    spark = docs.sparkSession
    got = measures(docs.select(q(doc_id).alias("__id"), F.col(text).alias("__text")), rules, "__text", ("__id",))
    got, _ = table(spark, got.withColumn("__row", F.monotonically_increasing_id()))
    marked = mark_target(got, trusted.select(q(doc_id).alias("__trusted_id")))
    n, halves = [0] * rules.buckets, [[0] * rules.buckets, [0] * rules.buckets]
    for r in bucket_counts(marked).collect():  # at most one row a bucket
        n[r["x"]], halves[0][r["x"]], halves[1][r["x"]] = r["n"], r["n_0"], r["n_1"]
    threshold = target_threshold(marked.where("__half is not null"), n, halves, rules)
    ratios = log_ratios(n, [x + y for x, y in zip(*halves, strict=True)], rules)
    scored = got.withColumn("score", _mean_ratio(ratios)).drop("features", "__row").withColumnRenamed("__id", doc_id)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
