"""Mixing sources to target weights, by fitting subset sums to token budgets.

Each listed source gets a budget: its share of the whole number of tokens to be mixed. If a source can't fill its share of all
tokens there are with max_repeats uses of each document, the whole number is lowered until it can (not below LEAST_TOTAL of
all tokens, and sources that have no tokens to give aside), so that no source stands above its target for another's lack. Its documents are counted by
exact length in tokens. A common part of every length's uses is taken at once; what remains of the budget is
filled by a bounded-knapsack dynamic program over the lengths that are left, whose set of reachable sums is the bits of
one whole number. The uses of a length are then spread over its documents, the seeded order deciding who gets one more.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.tokens import VOCABULARY, counter
from foliospark.runtime import materialize

SEED = 20240501
#: The dynamic program fills at most about so many tokens of a budget; the rest is taken in whole uses of lengths.
WINDOW = 40_000
BUCKETS = 1024
#: The whole number of tokens is lowered to at least this share of all tokens of the listed sources.
LEAST_TOTAL = 0.25


def fill(lengths: list[int], left: list[int], budget: int) -> list[int]:
    """Uses of each length (at most `left`) whose sum comes nearest to the budget from below: bounded knapsack on bits, lengths taken in the order given."""
    mask = (1 << (budget + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (item, uses, sums reachable before)
    for i in range(len(lengths)):
        n = min(left[i], budget // lengths[i])
        part = 1
        while n:
            k = min(part, n)
            steps.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & mask
            n -= k
            part *= 2
        if reach >> budget & 1:
            break
    rest = reach.bit_length() - 1
    uses = [0] * len(lengths)
    for i, k, before in reversed(steps):
        if not before >> rest & 1:
            uses[i] += k
            rest -= k * lengths[i]
    return uses


def fit_budget(lengths: list[int], capacity: list[int], budget: int, seed: int = SEED) -> list[int]:
    """Uses of each length, at most its capacity, whose sum is the budget or as near below it as can be.

    All lengths give the same part of their capacity, rounded along a seeded order so that short and long texts are
    taken alike; the dynamic program fills the last WINDOW tokens, going along the same order.
    """
    total = sum(n * c for n, c in zip(lengths, capacity))
    if total <= budget:
        return list(capacity)
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    window = max(WINDOW, 4 * max(lengths, default=0))
    part = max(budget - window // 2, 0)
    uses, sum_before = [0] * len(lengths), 0
    for i in order:  # running sum of the parts, in units of 1 / total
        uses[i] = (sum_before % total + capacity[i] * part) // total
        uses[i] = min(uses[i], capacity[i])
        sum_before += capacity[i] * part
    rest = budget - sum(n * u for n, u in zip(lengths, uses))
    for i in order:
        if rest >= 0:
            break
        k = min(uses[i], -(rest // lengths[i]))
        uses[i] -= k
        rest += k * lengths[i]
    while rest > 2 * window:
        before = rest
        for i in order:
            k = min(capacity[i] - uses[i], max((rest - window) // lengths[i], 0), 1)
            uses[i] += k
            rest -= k * lengths[i]
        if rest == before:
            break
    more = fill([lengths[i] for i in order], [capacity[i] - uses[i] for i in order], rest)
    for i, m in zip(order, more):
        uses[i] += m
    return uses


class Mixture:
    """The chosen documents and the actual shares.

    documents: doc_id (unique), text, source; targets: source (unique), target_share, max_repeats. The tokens to be
    mixed are `total`, or else as many of those of all listed sources' documents together (`all_tokens`) as leave every source that has
    any within reach of its target. A source that can't fill its budget with max_repeats uses of each document gives all of them. Documents without tokens (null and empty texts), without a source or of a
    source that isn't listed aren't chosen; a null share or number of repeats counts as 0. Equal texts under other ids
    are documents of their own. Empty tables give no documents and shares of 0.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, vocabulary: str = VOCABULARY):
        self.targets = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source is not null")
        listed = documents.select("doc_id", "source", "text").join(self.targets.select("source"), "source", "left_semi")
        count = counter(vocabulary)
        self.sized = materialize(listed.select("doc_id", "source", count("text").alias("n_tokens")))
        kept = self.sized.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int"))
        self.kept, self.seed = kept, seed
        # documents by source, length and seeded bucket: what is ranked later is never more than one bucket
        self.buckets = materialize(kept.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("docs")))
        self.all_tokens = self.buckets.agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t")).first()["t"] or 0
        self.total = total if total is not None else self._reachable()
        self.plan = materialize(self._plan())

    def _reachable(self) -> int:
        """The greatest total, up to all tokens, of which every source that has tokens to give can fill its share."""
        given = self.buckets.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t")).join(self.targets, "source")
        most = given.where("target_share > 0 and max_repeats > 0").agg(F.min(F.col("t") * F.col("max_repeats") / F.col("target_share"))).first()[0]
        return self.all_tokens if most is None else max(min(self.all_tokens, math.floor(most)), math.ceil(LEAST_TOTAL * self.all_tokens))

    def _plan(self) -> DataFrame:
        """(source, n_tokens, uses, docs): uses of each length. A source's group has a row for each length only."""
        total, seed = self.total, self.seed
        lengths = self.buckets.groupBy("source", "n_tokens").agg(F.sum("docs").alias("docs")).join(self.targets, "source")

        def fitted(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("n_tokens")
            repeats = max(int(group["max_repeats"].iloc[0]), 0)
            budget = max(math.floor(float(group["target_share"].iloc[0]) * total + 0.5), 0)
            uses = fit_budget([int(x) for x in group["n_tokens"]], [int(x) * repeats for x in group["docs"]], budget, seed)
            return group.assign(uses=uses)[["source", "n_tokens", "docs", "uses"]]

        return lengths.groupBy("source").applyInPandas(fitted, "source string, n_tokens int, docs bigint, uses bigint").where("uses > 0")

    def chosen(self) -> DataFrame:
        """(doc_id, source, n_tokens, uses): the chosen documents. Of each length all get the same number of uses, and the first in seeded order one more."""
        rest = F.col("uses") - F.floor(F.col("uses") / F.col("docs")) * F.col("docs")
        shares = self.plan.select("source", "n_tokens", F.floor(F.col("uses") / F.col("docs")).alias("base"), rest.alias("extra"))
        below = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        spread = self.buckets.join(shares, ["source", "n_tokens"]).withColumn("before", F.coalesce(F.sum("docs").over(below), F.lit(0)))
        spread = spread.withColumn("more", F.greatest(F.lit(0), F.least(F.col("docs"), F.col("extra") - F.col("before"))))
        rows = self.kept.join(spread, ["source", "n_tokens", "bucket"])
        whole = rows.where((F.col("more") == 0) | (F.col("more") == F.col("docs"))).select("doc_id", "source", "n_tokens", (F.col("base") + (F.col("more") > 0).cast("bigint")).alias("uses"))
        order = Window.partitionBy("source", "n_tokens", "bucket").orderBy(F.xxhash64(F.lit(self.seed), F.lit("order"), F.col("doc_id")), "doc_id")
        edge = rows.where((F.col("more") > 0) & (F.col("more") < F.col("docs"))).withColumn("rank", F.row_number().over(order))
        part = edge.select("doc_id", "source", "n_tokens", (F.col("base") + (F.col("rank") <= F.col("more")).cast("bigint")).alias("uses"))
        return whole.unionByName(part).where("uses > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, max_repeats, tokens, budget, nominal_budget, documents, uses): one row for each listed source. nominal_budget: its share of all tokens, before the whole number was lowered."""
        used = self.chosen().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"))
        rows = self.targets.join(used, "source", "left").fillna(0, ["tokens", "documents", "uses"])
        all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over the listed sources only, a row for each
        share = F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(0.0)
        return rows.select("source", "target_share", share.alias("actual_share"), "max_repeats", "tokens", F.floor(F.col("target_share") * self.total + 0.5).alias("budget"), F.floor(F.col("target_share") * self.all_tokens + 0.5).alias("nominal_budget"), "documents", "uses")
