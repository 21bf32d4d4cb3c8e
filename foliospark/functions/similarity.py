"""Sequence similarity: Arrow-batched functions over the standard library's matcher, which Catalyst has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import NEARLY, OVERLAP_WEIGHT, code_form, content_type


def matched(a, b) -> int:
    return sum(size for _, _, size in SequenceMatcher(None, a, b).get_matching_blocks())


def matched_ratio(a, b) -> float:
    return SequenceMatcher(None, a, b).ratio()


def matched_percent(a, b) -> float:
    """Percentage of a's items in matching blocks; 0 for an empty a."""
    return 100.0 * matched(a, b) / len(a) if len(a) else 0.0


def by_row(of, a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else of(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    return by_row(matched_ratio, a, b)


def _shares(a: pa.Array, b: pa.Array) -> pa.Array:
    return by_row(matched_percent, a, b)


def sm_ratio(a: Column, b: Column) -> Column:
    """Ratio of the sequence matcher; it depends on the order of its arguments. Null if either is null."""
    return F.arrow_udf(_ratios, "double")(a, b)


def matched_share(a: Column, b: Column) -> Column:
    """Percentage of a's items (characters of strings, words of arrays) in matching blocks; 0 for an empty a."""
    return F.arrow_udf(_shares, "double")(a, b)


def with_similarity(rows: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """Rows with the similarity of two texts in the form that suits a's content type; for plain language below 0.7 the word overlap times 0.8 if that is more. 0 if either is empty.

    The steps are columns of their own, so that no form is computed twice.
    """
    hard = F.col("_kind").isin("code", "command", "config")
    kept = rows.withColumns({"_a": a, "_b": b}).withColumn("_kind", content_type(F.col("_a")))
    kept = kept.withColumns({f"_{n}": F.when(hard, code_form(F.col(c), True)).otherwise(code_form(F.col(c))) for n, c in (("x", "_a"), ("y", "_b"))})
    kept = kept.withColumn("_ratio", sm_ratio(F.col("_x"), F.col("_y")))
    wx, wy = F.array_distinct(F.split("_x", " ")), F.array_distinct(F.split("_y", " "))
    empty = (F.coalesce("_x", F.lit("")) == "") | (F.coalesce("_y", F.lit("")) == "")
    plain = (F.col("_kind") == "natural_language") & (F.col("_ratio") < NEARLY)
    value = F.when(empty, F.lit(0.0)).when(plain, F.greatest("_ratio", jaccard(wx, wy) * OVERLAP_WEIGHT)).otherwise(F.col("_ratio"))
    return kept.withColumn(name, value).drop("_a", "_b", "_kind", "_x", "_y", "_ratio")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


DIFF = "kind string, position_a int, position_b int, text_a string, text_b string, before_a string, after_a string, before_b string, after_b string, words_a int, words_b int"


def word_differences(a: list[str], b: list[str], around: int = 5) -> list[tuple]:
    """Differences of two word lists, each with the words around it."""
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b).get_opcodes():
        if kind != "equal":
            sides = [(w[s:e], w[max(s - around, 0) : s], w[e : e + around]) for w, s, e in ((a, i, j), (b, k, m))]
            (ta, ba, aa), (tb, bb, ab) = [tuple(" ".join(part) for part in side) for side in sides]
            out.append((kind, i, k, ta, tb, ba, aa, bb, ab, j - i, m - k))
    return out


def differences(a: Column, b: Column) -> Column:
    """Array of the word differences of two word arrays; null arrays count as empty."""

    def diff(x: pd.Series, y: pd.Series) -> pd.Series:
        names = [c.split()[0] for c in DIFF.split(", ")]
        return pd.Series([[dict(zip(names, d)) for d in word_differences(list(p) if p is not None else [], list(q) if q is not None else [])] for p, q in zip(x, y)])

    return F.pandas_udf(diff, f"array<struct<{DIFF.replace(' string', ': string').replace(' int', ': int')}>>")(a, b)
