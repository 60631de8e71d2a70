"""Quality rules: how much likelier a document's hashed n-grams are in a trusted part than in the whole corpus.  DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ragged, shared

SPACES = r"[ \t\n\x0B\f\r]+"
#: Characters that prose has few of; fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: At most so many identifiers are broadcast, after they have been counted; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Scores are counted in bins of this width first; only the bins' totals reach the driver.
BIN = 1 / 256


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def paired(hashes: Column) -> Column:
    """A hash of each word and the one before it; the first word has none.  ``hashes`` must be a column, as any expression would
    be evaluated again for each element."""
    two = F.transform(hashes, lambda h, i: F.xxhash64(F.get(hashes, i - 1), h))
    return F.slice(two, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))


def features(buckets: int) -> Column:
    """Buckets of hashed unigrams and bigrams of whole words, from the columns ``hashes`` and ``pairs``."""
    return F.transform(F.concat("hashes", "pairs"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float) -> list[float]:
    """log p(bucket | trusted) - log p(bucket | corpus).  All documents are counted; ``buckets`` rows reach the driver.

    The corpus is smoothed by ``smoothing`` for each bucket, the trusted part by as much in all, shared as the corpus is: with
    few trusted documents ratios tend to 1, not to the smoothing.
    """
    marked = docs.join(few(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    cut = marked.select(hashed(split_words(F.col("text"))).alias("hashes"), F.coalesce("good", F.lit(0)).alias("good")).withColumn("pairs", paired(F.col("hashes")))
    grams = cut.select(F.explode(features(buckets)).alias("bucket"), "good")
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).collect()
    all_n, good_n = sum(r.n for r in counted), sum(r.good for r in counted)
    if not good_n:
        return [0.0] * buckets
    of, prior = {r.bucket: (r.good, r.n) for r in counted}, smoothing * buckets
    weights = []
    for b in range(buckets):
        g, n = of.get(b, (0, 0))
        p = (n + smoothing) / (all_n + prior)
        weights.append(round(math.log((g + prior * p) / (good_n + prior) / p), 6))
    return weights


def few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def labelled(labels: DataFrame, half: int) -> DataFrame:
    """``doc_id, good`` of all labelled documents of one half of the labels, by a hash of the identifier.  A document that has
    both labels, or none, has none here."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = known.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").select("doc_id", (F.col("low") == 1).alias("good"))
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == half)


def best_threshold(scores: list[tuple[float, bool]]) -> float:
    """Where the share of good documents at or above it, plus the share of bad ones below it, is largest; the middle between two
    scores, and the lowest of equally good ones.  Without documents of both kinds nothing is below it."""
    n_good = sum(good for _, good in scores)
    n_bad = len(scores) - n_good
    if not n_good or not n_bad:
        return -math.inf
    ordered = sorted(scores)
    best, at, value = 1.0, -math.inf, 1.0
    for k, (score, good) in enumerate(ordered):
        value += -1 / n_good if good else 1 / n_bad
        if k + 1 < len(ordered) and ordered[k + 1][0] > score and value > best + 1e-12:
            best, at = value, (score + ordered[k + 1][0]) / 2
    return at


def placed_windows(windows: Column) -> Column:
    """The hashes of ``windows`` with their places, sorted by hash; empty if none occurs twice."""
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_words(placed: Column) -> Column:
    """How many words lie in windows that occur at least twice.  ``placed`` must be a column, as in features()."""
    twice = F.filter(placed, lambda p, k: F.coalesce((k > 0) & (F.get(placed, k - 1)["h"] == p["h"]), F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == p["h"], F.lit(False)))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    return F.aggregate(F.sort_array(F.transform(twice, lambda p: p["i"])), start, step, lambda acc: acc["n"])


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that score() keeps.  Rows without doc_id go."""
    row = docs.select(F.col("doc_id"), F.col("text"), F.struct("*").alias("row"))
    judged = score(row, labels, carry=["row"], **options)
    # a filter would be pushed below the projections, which it would then repeat for each of its references; a generator is not
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def mean_ratio(weights: list[float]) -> tuple[Column, Column]:
    """The sum of the weights of a column ``grams``, and their mean from a column ``total``."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b)), F.when(F.size("grams") > 0, F.col("total") / F.size("grams")).otherwise(0.0)


def threshold_of(scored: DataFrame) -> float:
    """best_threshold() of all rows ``score, good``, without bringing them to the driver."""
    counted = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted = shared.stored(counted.withColumn("bin", F.floor(F.col("score") / BIN).cast("long")), "scores", {})
    bins = counted.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("bin").collect()
    n_good, n_bad = sum(r.good for r in bins), sum(r.bad for r in bins)
    if not n_good or not n_bad:
        return -math.inf
    before, good, bad = [], 0, 0
    for r in bins:
        before.append((r.bin, good, bad))
        good, bad = good + r.good, bad + r.bad
    below = counted.sparkSession.createDataFrame(before, "bin long, good_before long, bad_before long")
    up_to = lambda c: F.col(f"{c}_before") + F.sum(c).over(Window.partitionBy("bin").orderBy("score"))
    value = up_to("bad") * n_good - up_to("good") * n_bad
    best = counted.join(F.broadcast(below), "bin").select("score", value.alias("value")).orderBy(F.desc("value"), "score").first()
    if best.value <= 0:
        return -math.inf
    return (best.score + counted.where(F.col("score") > best.score).agg(F.min("score")).first()[0]) / 2


def fit_threshold(docs: DataFrame, held_out: DataFrame, weights: list[float], buckets: int) -> float:
    """The best threshold of all labelled documents that are not among the trusted."""
    total, mean = mean_ratio(weights)
    some = docs.join(few(held_out), "doc_id").select("good", hashed(split_words(F.col("text"))).alias("hashes"))
    scored = some.withColumn("pairs", paired(F.col("hashes"))).withColumn("grams", features(buckets)).withColumn("total", total).select(mean.alias("score"), "good")
    return threshold_of(scored)


def score(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = 1 << 16, smoothing: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Rule counts, and the mean log likelihood ratio of the document's hashed n-grams.

    The trusted multinomial is that of all good documents of one half of the labels; the other is that of all documents.  ``score`` is the mean over the document's unigrams and bigrams of words, so length has no
    influence, and 0 where there are none.  A document passes the method if ``score >= threshold``, by default the one that
    parts all documents of the other half of the labels best, and is kept if it also passes the base rules: at
    least 20 words (so null and empty texts fail) and at most 30 % of them in repeated windows of 8 words.  Without labels all
    scores are 0 and pass.
    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``.  A map over
    the documents after one count by bucket; no text is shuffled.  Columns named in ``carry`` come along.
    """
    carry = carry or []
    docs = ragged.documents(docs, carry)
    plain = docs.select("doc_id", "text")
    weights = ratio_weights(plain, labelled(labels, 0).where("good").select("doc_id"), buckets, smoothing)
    if threshold is None:
        threshold = fit_threshold(plain, labelled(labels, 1), weights, buckets)
    total, mean = mean_ratio(weights)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    first = docs.select(*carry, "doc_id", "text", split_words(text).alias("words"), lines.alias("lines"))
    second = first.select(
        *carry,
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashed(F.col("words")).alias("hashes"),
    )
    count = F.size("hashes") - (WINDOW - 1)
    windows = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(F.col("pairs"), i + k) for k in range(0, WINDOW, 2)]))).otherwise(F.array().cast("array<bigint>"))
    third = second.withColumn("pairs", paired(F.col("hashes"))).withColumn("windows", windows).withColumn("grams", features(buckets)).withColumn("total", total)
    fourth = third.withColumn("placed", placed_windows(F.col("windows"))).withColumn("n_repeat_words", repeated_words(F.col("placed")).cast("long"))
    fifth = fourth.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).withColumn("score", mean)
    return fifth.select(*carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
