import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import repetition
from foliospark.llm.repetition import Segments, fit, measure, planted, record_texts, viterbi
from foliospark.sources.tables import recognition_schema


def brute(text):
    words, seen = re.findall(r"\w+", text.lower()), set()
    mark = [False] * len(words)
    for i in range(len(words) - 4):
        stretch = tuple(words[i : i + 5])
        if stretch in seen:
            mark[i : i + 5] = [True] * 5
        seen.add(stretch)
    return sum(mark) / max(len(words), 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d. e\n f! _g 7".split(" ")), max_size=40).map(" ".join), max_size=6))
def test_exact_share(texts):
    assert np.allclose(Segments(texts).share(), [brute(t) for t in texts])


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        score, move = rng.normal(size=(1, n)), rng.normal(size=(2, 2))
        value = lambda y: sum(score[0, t] * y[t] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n))
        best = max((tuple(int(b) for b in f"{k:0{n}b}") for k in range(2**n)), key=value)
        assert tuple(viterbi(score, np.array([n]), move)[0]) == best


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(12)]
        if i % 3 == 0:
            lines += [rng.choice(lines) for _ in range(rng.randint(1, 20))]
        out.append(".\n".join(lines))
    return out


def test_field_leaves_every_case_to_the_exact_share():
    texts = corpus(3, 120)
    content, exact = measure(texts)
    truth = np.array([brute(t) for t in texts])
    assert np.allclose(exact, truth)
    cases = truth >= 0.3
    assert cases.sum() > 10 and (content[cases] < repetition.RETAINED_SHARE).all() and (content[truth < 0.02] >= repetition.RETAINED_SHARE).mean() > 0.95


def test_small_shares_are_kept():
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words + words[:7])
    content, exact = measure([text, " ".join(words), "", " \n"])
    assert exact[0] == 7 / 107 and list(exact[1:]) == [0, 0, 0] and list(content[2:]) == [1, 1]


def test_spam_in_one_line():
    content, exact = measure(["do not repaint " * 60, "Every conduit must be " * 40 + "closed."])
    assert (exact > 0.9).all() and (content < 0.5).all()


def test_fit_on_held_out():
    """Fitted on planted places, the field finds those of other texts."""
    w, t = fit(*planted(corpus(5, 60), 1), steps=150)
    texts, spans = planted(corpus(6, 60), 2)
    s = Segments(texts)
    x, _ = s.observations()
    gold = repetition.labels(s, texts, spans)
    table, doc, at = s.grid(x @ w)
    found = viterbi(table, np.bincount(s.segment_doc, minlength=len(texts)), t)[doc, at]
    assert gold.sum() > 100 and (found * gold).sum() / found.sum() > 0.95 and (found * gold).sum() / gold.sum() > 0.95


def test_spark(spark):
    schema = recognition_schema(["text"], ["rec_id"])
    again = "one two three four five six seven"
    rows = [(1, [(2, [(again,), None, (None,)]), (1, [(again,)]), (3, None)]), (2, None), (3, []), (4, [(1, [("",)])]), (None, [(1, [(again + " " + again,)])])]
    out = repetition.repetition(record_texts(spark.createDataFrame(rows, schema)), ["rec_id"]).collect()
    assert {r.rec_id: r.repeated_share for r in out} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, None: 0.5}
    assert {r.rec_id: r.retained for r in out} == {1: False, 2: True, 3: True, 4: True, None: False}
    assert repetition.repetition(spark.createDataFrame([], "rec_id bigint, text string"), ["rec_id"]).count() == 0
