"""Accuracy of extracted sections and texts against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.similarity import differences, matched_share
from foliospark.functions.text import words


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, to four decimals; 0 where there is nothing to divide by."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1_score": F.round(safe(2 * p * r, p + r), 4)}


def set_accuracy(truth: DataFrame, found: DataFrame, by: list[str], item: str) -> DataFrame:
    """Rates and counts of distinct items by group: one full outer join counts what is in both, in one only."""
    a = truth.select(*by, item).distinct().withColumn("_t", F.lit(1))
    b = found.select(*by, item).distinct().withColumn("_f", F.lit(1))
    both = a.join(b, [*by, item], "full")
    t, f = F.col("_t").isNotNull(), F.col("_f").isNotNull()
    out = both.groupBy(*by).agg(F.count_if(t & f).alias("true_positives"), F.count_if(f & ~t).alias("false_positives"), F.count_if(t & ~f).alias("false_negatives"))
    return out.withColumns(rates(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")))


def level_accuracy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Rates by doc and level, over the levels of either side, with the numbers of paths. Inputs: doc, path, level."""
    rows = set_accuracy(truth, found, ["doc", "level"], "path")
    return rows.select("doc", "level", "precision", "recall", "f1_score", (F.col("true_positives") + F.col("false_negatives")).alias("count_gt"), (F.col("true_positives") + F.col("false_positives")).alias("count_extracted"))


def missing(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, path) in the truth but not found; with the sides changed, the extra ones."""
    return truth.select("doc", "path").distinct().join(found.select("doc", "path").distinct(), ["doc", "path"], "left_anti")


def listed(rows: DataFrame, keys: list[str], item: str, most: int = 10) -> DataFrame:
    """(keys, n, items): the number of distinct items of each group and the first of them in order, at most `most`.

    Ranks are cut before items are gathered, so a group never gathers more than it shows.
    """
    order = Window.partitionBy(*keys).orderBy(item)
    distinct = rows.select(*keys, item).distinct()
    shown = distinct.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")), keys)


def outcomes(rows: DataFrame, keys: list[str], failed: Column, changes: Column) -> DataFrame:
    """(keys, n, n_changed, n_skipped, n_failed, total, rate): how a batch went: rows that changed, had nothing to change, or failed; changes in all; rate of rows that didn't fail, in percent."""
    bad, n = F.coalesce(failed, F.lit(False)), F.coalesce(changes, F.lit(0))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~bad & (n > 0)).alias("n_changed"), F.count_if(~bad & (n <= 0)).alias("n_skipped"), F.count_if(bad).alias("n_failed"), F.sum(F.when(~bad, n).otherwise(0)).alias("total"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.round((F.col("n") - F.col("n_failed")) / F.col("n") * 100, 4)).otherwise(0.0))


def text_accuracy(pairs: DataFrame) -> DataFrame:
    """Character and word accuracy of `found` against `truth` in percent, with their counts. Null texts count as empty."""
    a, b = F.coalesce("truth", F.lit("")), F.coalesce("found", F.lit(""))
    sized = pairs.withColumns({"chars": matched_share(a, b), "_wa": words(a), "_wb": words(b)})
    return sized.withColumns({"words": matched_share(F.col("_wa"), F.col("_wb")), "n_chars_truth": F.length(a), "n_chars_found": F.length(b), "n_words_truth": F.size("_wa"), "n_words_found": F.size("_wb")}).drop("_wa", "_wb", "truth", "found")


def word_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each difference of the words of truth and found, numbered, with five words around it on either side."""
    a, b = words(F.coalesce("truth", F.lit(""))), words(F.coalesce("found", F.lit("")))
    return pairs.select(*keys, F.posexplode(differences(a, b)).alias("_n", "_d")).select(*keys, (F.col("_n") + 1).alias("difference_number"), "_d.*")


def difference_histogram(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of replaced, deleted and inserted stretches, zero where there are none."""
    return diff.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("replace", "delete", "insert")])
