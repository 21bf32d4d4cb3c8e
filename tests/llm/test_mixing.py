import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm.mixing import LEAST_TOTAL, Mixture, fill, fit_budget
from foliospark.llm.tokens import VOCABULARY, encode_texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3)), max_size=4, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_fill_against_all_choices(items, budget):
    lengths, left = [x[0] for x in items], [x[1] for x in items]
    uses = fill(lengths, left, budget)
    got = sum(a * b for a, b in zip(lengths, uses))
    best = max(s for s in (sum(a * b for a, b in zip(lengths, c)) for c in itertools.product(*[range(n + 1) for n in left])) if s <= budget)
    assert got == best and all(0 <= u <= n for u, n in zip(uses, left))


def test_fit_large():
    lengths, capacity = list(range(50, 900, 7)), [400] * 122
    total = sum(a * b for a, b in zip(lengths, capacity))
    for budget in (0, 49, 123_457, total // 2, total - 1, total, total + 5):
        uses = fit_budget(lengths, capacity, budget)
        got = sum(a * b for a, b in zip(lengths, uses))
        assert all(0 <= u <= c for u, c in zip(uses, capacity)) and got <= budget
        assert got == budget or budget in (49, total - 1, total + 5)


def test_mixture(spark):
    rows = [(i, "word " * (1 + i % 13) + str(i), "big" if i % 3 else "mid", "clash") for i in range(300)]
    rows += [(1000 + i, "tiny text", "small", "x") for i in range(3)] + [(2000, None, "big", "x"), (2001, "", "mid", "x"), (2002, "stray", None, "x"), (2003, "stray", "unlisted", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, uses string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 3), ("small", 0.1, 2), ("none", 0.0, None)], "source string, target_share double, max_repeats int")
    whole = Mixture(docs, targets).all_tokens
    mix = Mixture(docs, targets, whole)
    size = {r[0]: len(ids) for r, ids in zip(rows, encode_texts([r[1] for r in rows], VOCABULARY))}
    cap = {"big": 1, "mid": 3, "small": 2}
    chosen = mix.chosen().collect()
    assert len({r.doc_id for r in chosen}) == len(chosen) and all(r.n_tokens == size[r.doc_id] and 1 <= r.uses <= cap[r.source] for r in chosen)
    total = sum(size[r[0]] for r in rows if r[2] in cap)
    assert whole == total
    shares = {r.source: r for r in mix.shares().collect()}
    tokens = {s: sum(r.n_tokens * r.uses for r in chosen if r.source == s) for s in shares}
    assert tokens["big"] == shares["big"].budget == round(0.5 * total) and tokens["mid"] == round(0.4 * total)
    assert tokens["small"] == 2 * sum(size[1000 + i] for i in range(3)) and tokens["none"] == 0
    assert all(r.tokens == tokens[s] and abs(r.actual_share - tokens[s] / sum(tokens.values())) < 1e-12 for s, r in shares.items())
    again = {(r.doc_id, r.uses) for r in Mixture(docs.repartition(7), targets, whole).chosen().collect()}
    assert again == {(r.doc_id, r.uses) for r in chosen}
    empty = Mixture(docs.limit(0), targets)
    assert empty.chosen().count() == 0 and {r.actual_share for r in empty.shares().collect()} == {0.0}


def test_total_within_reach(spark):
    """The whole is lowered until the source that has least can fill its share, so all stand on their targets."""
    rows = [(i, "word " * (1 + i % 29) + str(i), "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], "clash") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, total string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.45, 2), ("c", 0.15, 1), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix = Mixture(docs, targets)
    shares = {r.source: r for r in mix.shares().collect()}
    assert mix.total < mix.all_tokens and shares["gone"].tokens == 0 and shares["c"].nominal_budget > shares["c"].budget
    for source, target in (("a", 0.3), ("b", 0.45), ("c", 0.15)):
        assert abs(shares[source].actual_share - target / 0.9) < 0.001 and shares[source].tokens <= shares[source].budget
    assert all(1 <= r.uses <= {"a": 1, "b": 2, "c": 1}[r.source] for r in mix.chosen().collect())
    low = Mixture(docs, spark.createDataFrame([("a", 0.9, 1), ("c", 0.1, 1), ("b", 0.0, 1)], targets.schema).withColumn("target_share", F.when(F.col("source") == "c", 0.99).otherwise(0.01)))
    assert low.total == math.ceil(LEAST_TOTAL * low.all_tokens)


def test_ties_go_by_seed(spark):
    docs = spark.createDataFrame([(i, "same text", "a") for i in range(5000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    n = Mixture(docs, targets).all_tokens
    one, two = ({r.doc_id for r in Mixture(docs, targets, n // 3, seed).chosen().collect()} for seed in (1, 2))
    assert len(one) == len(two) and 0.2 < len(one & two) / len(one) < 0.5
