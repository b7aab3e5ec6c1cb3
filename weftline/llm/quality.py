"""Quality rules whose cutoffs come with a bound on good documents lost.

Each rule rejects a document whose measure lies above a cutoff. The candidates for
each cutoff are fixed beforehand, from lenient to strict. Labelled documents that are
not used to choose the candidates serve as a holdout: for every stratum and rule the
good ones above a candidate are counted, and a candidate is certified if so few
losses, or fewer, would have a probability of at most DELTA / (rules * strata) under
a loss rate of ALPHA / rules (exact binomial tail, the Clopper-Pearson bound). Candidates
are tested in order and testing stops at the first that is not certified, so each
stratum and rule costs one test (fixed-sequence testing) and the Bonferroni division
covers the rest: with probability 1 - DELTA, no stratum loses more than ALPHA of its good
documents to all rules together. A stratum with too few labels certifies nothing
and loses nothing to the rules.

Everything is DataFrame functions. Words are runs of characters other than ASCII
white space. Null text has no words; a null stratum is a stratum of its own; documents
with several labels count as good if one of them is; labels of unknown documents
are not used. Repeated rows are judged alike, and so are ties: a measure equal to a cutoff stays. Texts are measured
whole, however long. An empty table gives an empty result; without labels nothing is certified. Columns of the input other than the
text, the id and the stratum are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialize

ALPHA, DELTA = 0.02, 0.05
MOST_STRATA, MOST_LABELS = 10_000, 1_000_000
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

SPACE = " \t\n\x0b\x0c\r"
#: rule: its measure (a figure times a sign, over a figure) and its candidates from lenient to strict
RULES: dict[str, tuple[tuple[str, int, str], tuple[float, ...]]] = {
    "symbols": (("n_symbols", 1, "n_words"), (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1)),
    "lines": (("n_dup_lines", 1, "n_lines"), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": (("n_repeat_words", 1, "n_words"), (0.18, 0.15, 0.12, 0.1, 0.08, 0.05)),
    "capitals": (("n_capitals", 1, "word_chars"), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "long_words": (("word_chars", 1, "n_words"), (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
    "short_words": (("word_chars", -1, "n_words"), (-1.5, -2.0, -2.5, -3.0, -3.5)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes by window start."""

    def spread(ordered: Column) -> Column:
        near = lambda i: F.get(ordered, i)["h"]
        same = lambda x, i: F.coalesce(near(i - 1) == x["h"], F.lit(False)) | F.coalesce(near(i + 1) == x["h"], F.lit(False))
        return _let(
            F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["i"])),
            lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - x), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x),
        )

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(marked, spread))


def _repeat_words(words: Column) -> Column:
    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )
    own = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(own, lambda w: _let(windows(w), _covered)))


def figures(text: Column) -> Column:
    """Struct of the base figures, n_lines and n_capitals of a text."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    long = lambda c: c.cast("long")
    kept = lambda those: long(F.length(F.regexp_replace(text, those, "")))

    def told(w: Column, x: Column) -> Column:
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), kept(r"[^#*$%&|<>]+").alias("n_symbols"),
            long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), long(F.size(x)).alias("n_lines"), kept("[^A-Z]+").alias("n_capitals"),
        )

    by_words = _let(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    return _let(by_words, lambda w: _let(lines, lambda x: told(w, x)))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])


def _measure(rule: str, f: Column) -> Column:
    (top, sign, bottom), _ = RULES[rule]
    return F.when(f["n_words"] > 0, sign * f[top].cast("double") / f[bottom])


def _rejected(f: Column, limits: Column) -> Column:
    first, *rest = (F.coalesce(_measure(r, f) > limits[r], F.lit(False)) for r in RULES)
    for r in rest:
        first = first | r
    return first


def _tail(k: Column, n: Column, rate: float) -> Column:
    """P(at most k of n) for k up to n * rate; above, 1, as the tail is then past any level used here."""
    odds = math.log(rate) - math.log1p(-rate)
    start = F.struct((n * F.lit(math.log1p(-rate))).alias("term"), (n * F.lit(math.log1p(-rate))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    counted = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * F.lit(rate), F.lit(1.0)).otherwise(F.exp(F.aggregate(counted, start, step)["total"]))


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(__wl_stratum, one cutoff per rule or null) from good(__wl_stratum, __wl_f): the good labelled documents with their figures."""
    counts = [F.sum((_measure(r, F.col("__wl_f")) > c).cast("long")).alias(f"{r}_{i}") for r, (_, cs) in RULES.items() for i, c in enumerate(cs)]
    rows = good.filter(~base_failed(F.col("__wl_f"))).groupBy("__wl_stratum").agg(F.count("*").alias("n"), *counts)
    strata = good.select("__wl_stratum").distinct().count()
    level = F.lit(delta / (len(RULES) * max(strata, 1)))

    def chosen(rule: str) -> Column:
        tries = [F.struct(F.lit(c).alias("c"), (_tail(F.coalesce(F.col(f"{rule}_{i}"), F.lit(0)), F.col("n"), alpha / len(RULES)) <= level).alias("ok")) for i, c in enumerate(RULES[rule][1])]
        start = F.struct(F.lit(None).cast("double").alias("c"), F.lit(True).alias("going"))
        go = lambda acc, x: F.when(acc["going"] & x["ok"], F.struct(x["c"].alias("c"), F.lit(True).alias("going"))).otherwise(F.struct(acc["c"].alias("c"), F.lit(False).alias("going")))
        return F.aggregate(F.array(*tries), start, go)["c"].alias(rule)

    return rows.select("__wl_stratum", *map(chosen, RULES))


def with_limits(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """docs(..., __wl_stratum) with the struct __wl_limits of its stratum's cutoffs."""
    if limits.count() <= MOST_STRATA:
        limits = F.broadcast(limits)  # one row of a few numbers per stratum
    return docs.join(limits.select("__wl_stratum", F.struct(*RULES).alias("__wl_limits")), "__wl_stratum", "left")


def _stratum(stratum: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))


def _few(labels: DataFrame) -> DataFrame:
    """Ids of good labels, broadcast while they are few, so that texts stay where they are; joined beyond."""
    good = good_labels(labels)
    return F.broadcast(good) if good.limit(MOST_LABELS + 1).count() <= MOST_LABELS else good


def _good_figures(docs: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    good = docs.select("doc_id", "text", stratum).join(_few(labels), "doc_id")
    return good.select(_stratum(stratum).alias("__wl_stratum"), figures(F.col("text")).alias("__wl_f"))


def quality_table(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, base figures, base_failed, kept) for each row of docs(doc_id, text, stratum)."""
    measured = docs.select("doc_id", _stratum(stratum).alias("__wl_stratum"), figures(F.col("text")).alias("__wl_f"))
    measured = materialize(measured, "figures")
    limits = materialize(cutoffs(measured.join(good_labels(labels), "doc_id")), "cutoffs")
    f = F.col("__wl_f")
    out = with_limits(measured, limits).withColumn("base_failed", base_failed(f))
    return out.select("doc_id", *[f[c].alias(c) for c in BASE], "base_failed", (~F.col("base_failed") & ~_rejected(f, F.col("__wl_limits"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    limits = materialize(cutoffs(materialize(_good_figures(docs, labels, stratum), "figures")), "cutoffs")
    marked = with_limits(docs.withColumn("__wl_stratum", _stratum(stratum)), limits)
    return marked.filter(_let(figures(F.col("text")), lambda f: ~base_failed(f) & ~_rejected(f, F.col("__wl_limits")))).select(*docs.columns)
