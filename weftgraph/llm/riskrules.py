"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Every rule rejects documents whose measure exceeds a cutoff.  SETTINGS is a fixed sequence
of joint settings of all rules, from the laxest to the strictest.  For each stratum they
are tested in that order on labelled good documents: with n of them, of which a setting
rejects k, the exact binomial tail P(Bin(n, limit) <= k) bounds the chance that the true
false-rejection rate of the whole rule set is `limit` or more.  A fixed sequence needs no
correction within a stratum; over strata, delta is shared out by their numbers of labelled
good documents (weighted Bonferroni).  So with probability 1 - delta no stratum loses more
than the limit of its good documents.  Of the settings that pass, the laxest is taken that
rejects as many labelled bad documents as any of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

LIMIT, DELTA = 0.02, 0.05
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
FEW_STRATA = 10_000

#: measure -> cutoffs, laxest first; the j-th of all measures are the j-th joint setting
SETTINGS = {
    "symbol_ratio": [0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01],
    "dup_line_ratio": [0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "repeat_ratio": [0.3, 0.3, 0.3, 0.28, 0.26, 0.24, 0.22, 0.2],  # the base rule has 0.3
    "upper_ratio": [0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.12, 0.1],
    "mean_word": [12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.75],
}
STEPS = len(SETTINGS["symbol_ratio"])


def without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def windows(h: Column, width: int = WINDOW) -> Column:
    """Hashes of every `width` consecutive elements."""
    each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return F.when(F.size(h) >= width, each).otherwise(F.expr("cast(array() as array<bigint>)"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts, base_failed, and `hit`, the first of SETTINGS that
    rejects the document (STEPS: none does)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    d = d.withColumn("w", words(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), F.length(without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("upper"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    d = d.withColumn("_win", windows(F.col("_h")))
    # places of windows that occur again: neighbours in the sorted list are equal
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda k: F.coalesce(F.get("_s", k)["x"] == F.get("_s", k - 1)["x"], F.lit(False)) | F.coalesce(F.get("_s", k)["x"] == F.get("_s", k + 1)["x"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_s") - 1), twin), lambda k: F.get("_s", k)["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", F.when(F.col("_s").isNotNull(), covered).otherwise(F.lit(0).cast("long")))
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    measures = {
        "symbol_ratio": F.col("n_symbols") / chars, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_ratio": F.col("n_repeat_words") / n,
        "upper_ratio": F.col("upper") / chars, "mean_word": F.col("word_chars") / n,
    }
    hit = F.least(*[sum((measures[m] <= c).cast("int") for c in cuts) for m, cuts in SETTINGS.items()])
    return d.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"), hit.alias("hit"),
    )


def log_tail(n: Column, k: Column, alpha: float) -> Column:
    """Natural log of P(Bin(n, alpha) <= k); 0 where k is over n * alpha, which no test needs."""
    odds = math.log(alpha) - math.log1p(-alpha)
    first = n * math.log1p(-alpha)
    step = lambda a, i: F.struct(
        (a["term"] + F.log((n - i + 1) / i) + odds).alias("term"),
        (F.greatest(a["total"], a["term"] + F.log((n - i + 1) / i) + odds) + F.log1p(F.exp(-F.abs(a["total"] - (a["term"] + F.log((n - i + 1) / i) + odds))))).alias("total"),
    )
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(k > n * alpha, F.lit(0.0)).otherwise(F.aggregate(upto, F.struct(first.alias("term"), first.alias("total")), step, lambda a: a["total"]))


def cutoffs(found: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """(stratum, setting): the place in SETTINGS of the setting chosen for each stratum that
    has any; found has doc_id, stratum, base_failed and hit."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).groupBy("doc_id").agg(F.min("q").alias("q"))
    held = found.where(~F.col("base_failed")).select("doc_id", "stratum", "hit").join(marks, "doc_id")
    sums = lambda q, name: [F.sum(((F.col("q") == q) & (F.col("hit") <= j)).cast("long")).alias(f"{name}{j}") for j in range(STEPS)]
    counts = held.groupBy("stratum").agg(F.sum((F.col("q") == 1).cast("long")).alias("n"), *sums(1, "k"), *sums(0, "bad"))
    total = counts.agg(F.sum("n").alias("total"))
    line = F.log(F.lit(float(delta)) * F.col("n") / F.col("total"))
    # what a stricter setting rejects, a laxer one may not, so tails rise along the sequence
    # and those that pass are its beginning, as a fixed sequence of tests demands
    passed = [F.when((F.col("n") > 0) & (log_tail(F.col("n"), F.col(f"k{j}"), limit) <= line), F.col(f"bad{j}")) for j in range(STEPS)]
    chosen = counts.join(F.broadcast(total)).withColumn("passed", F.array_compact(F.array(*passed)))
    return chosen.where(F.size("passed") > 0).select("stratum", (F.array_position("passed", F.array_max("passed")) - 1).cast("int").alias("setting"))


def judge(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, setting (null: none passed in its stratum).

    A null text has no words and fails the base rule; a null lang is a stratum of its own.
    A document labelled more than once is good if all its labels are, one without a quality
    is not labelled; rows that share a labelled doc_id count each.  Where labels don't
    suffice for a stratum, no rule rejects anything there.  An empty table gives no rows.
    """
    found = cut(measured(docs), "measured")
    limits = cutoffs(found, labels, limit, delta)
    if found.select("stratum").distinct().limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        limits = F.broadcast(limits)
    reject = F.coalesce(F.col("hit") <= F.col("setting"), F.lit(False))
    return found.join(limits, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~reject).alias("kept"), "setting")
