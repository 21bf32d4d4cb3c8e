import random
import time

import numpy as np

from foliospark.llm import matching
from foliospark.llm.matching import code_lines, overlap

CODE = "def {f}_{a}({b}, {c}=7):\n    {d} = []\n    for row in {b}:\n        if row['{e}'] > {n}:\n            {d}.append(row['{e}'] * {c})\n    return {g}_{h}({d})"


def piece(rng):
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    return CODE.format(f=rng.choice(["load", "scan"]), g=rng.choice(["trim", "pack"]), n=rng.randint(10, 999), **{k: name() for k in "abcdeh"})


def damage(rng, text):
    return "".join(rng.choice("xyz0;") if c.isalpha() and rng.random() < 0.06 else c for c in text)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_overlap():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 90))) for _ in range(2))
        assert overlap(a, b) == lcs(a, b)


def test_code_lines():
    assert code_lines("The pump was drained slowly by hand.\n1  x_1 = 2\n2  y = f(x_1)\n") == ["x_1 = 2", "y = f(x_1)"]


SIDE = ", ".join(f"{k} {t}" for k, t in matching.ATTRIBUTES.items())


def side(rows):
    """Rows of key, text, name, page (and an extra value) with empty context, box and score."""
    return [(*r[:4], None, None, None, *r[4:]) for r in rows]


def test_match(spark):
    rng = random.Random(5)
    pieces = [piece(rng) for _ in range(60)]
    docs = [(f"d{i:02d}", t, f"in/name{i}_of_doc.pdf", i % 5, "clash") for i, t in enumerate(pieces)] + [("null", None, None, None, "x"), ("blank", " ", None, 1, "x")]
    want, queries = {}, [("null", None, None, None, 1.0), ("blank", "\n", "name3", 1, 1.0)]
    for i, t in enumerate(pieces[:40]):
        kind = i % 4
        lines = t.split("\n")
        text = t if kind == 0 else damage(rng, t) if kind == 1 else "\n".join(lines[1:5]) if kind == 2 else "Some page text stands around this piece of it.\n" + t.replace("    ", " ")
        queries.append((f"q{i}", text, [None, f"Name{i} of doc", "other.pdf"][i % 3], [None, i % 5][i % 2], 1.0))
        want[f"q{i}"] = f"d{i:02d}"
    queries += [(f"n{i}", piece(rng), None, 1, 1.0) for i in range(10)]  # no counterpart
    half = [t.split("\n") for t in pieces[50:55]]
    queries += [(f"h{i}", "\n".join(piece(rng).split("\n")[:4] + lines[4:]), f"name{50 + i}", None, 1.0) for i, lines in enumerate(half)]  # shares names only
    queries += queries[2:5]
    q = spark.createDataFrame(side(queries), f"q string, {SIDE}, confidence double")
    d = spark.createDataFrame(side(docs + docs[:3]), f"d string, {SIDE}, q string")
    got = {r.q: (r.d, r.confidence) for r in matching.match(q, d).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(matching.MIN_CONFIDENCE <= c <= 1 for _, c in got.values())
    assert matching.match(q.limit(0), d).count() == 0 and matching.match(q, d.limit(0)).count() == 0


def test_copies(spark):
    """A piece that stands in more documents than any fixed bound keeps its terms."""
    rng = random.Random(8)
    hot, pieces = piece(rng), [piece(rng) for _ in range(120)]
    docs = [(f"h{i:02d}", hot, None, None) for i in range(40)] + [(f"d{i:03d}", t, None, None) for i, t in enumerate(pieces)]
    queries = [("same", hot, None, None), ("part", "\n".join(hot.split("\n")[1:]), "other name.pdf", 3), ("none", piece(rng), None, None)]
    q, d = spark.createDataFrame(side(queries), f"q string, {SIDE}"), spark.createDataFrame(side(docs), f"d string, {SIDE}")
    assert {r.q: r.d for r in matching.match(q, d).collect()} == {"same": "h00", "part": "h00"}
    alike = d.where("d < 'h'").limit(0).unionByName(d.where("d >= 'h'"))  # nothing but copies
    assert {r.q: r.d for r in matching.match(q, alike).collect()} == {"same": "h00", "part": "h00"}


def test_versions(spark):
    """Of many versions of one listing all that may be the best are compared; context and box tell equal ones apart."""
    rng = random.Random(9)
    base = piece(rng) + "\n    total = 100"
    docs = [(f"v{i:02d}", base.replace("100", str(100 + i)), "a.pdf", 1, None, None, None) for i in range(30)]
    docs += [("x1", piece(rng), None, None, "the pump was drained before noon", [10.0, 20.0, 110.0, 60.0], 0.9), ("x2", "", None, None, None, None, None)]
    docs.append(("x3", docs[-2][1] + " ", None, None, "an other text about the valve", [10.0, 400.0, 90.0, 460.0], None))
    docs += [(f"z{i}", piece(rng), None, None, None, None, None) for i in range(20)]
    queries = [(f"q{i:02d}", base.replace("100", str(100 + i)), None, None, None, None, 99.0) for i in (0, 17, 29)]
    queries += [("c1", docs[30][1], None, None, "the pump was drained before n0on", [4.8, 9.6, 52.8, 28.8], None), ("c3", docs[30][1], None, None, None, [43.2, 220.8, 4.8, 192.0], None)]
    got = {r.q: r.d for r in matching.match(spark.createDataFrame(queries, f"q string, {SIDE}"), spark.createDataFrame(docs, f"d string, {SIDE}")).collect()}
    assert got == {"q00": "v00", "q17": "v17", "q29": "v29", "c1": "x1", "c3": "x3"}


def test_likeness():
    assert matching.box_likeness([1, 2, 3, 4], [0.48, 0.96, 1.44, 1.92]) > 0.99 and matching.box_likeness([3, 4, 1, 2], [1, 2, 3, 4]) == 1
    assert matching.box_likeness([1, 2, 3, 4], [1, 2, 9, 4]) < 0.5 and matching.box_likeness(None, [1, 2, 3, 4]) == matching.box_likeness([1, 2], [1, 2, 3, 4]) == matching.box_likeness([0, 0, 0, 0], [0, 0, 0, 0]) == 0.5
    assert [matching.score_given(v) for v in (None, 0.5, 87.0, -1.0)] == [0.5, 0.5, 0.87, 0.0]
    assert matching.text_likeness(None, "a b") == 0.5 and matching.text_likeness("A b", "xa-yb") == 1


def test_planted_pairs_are_calibrated(spark):
    """Held out: pieces damaged in known ways are told from pieces made to look like them, and confidences are shares of right pairs."""
    rng = random.Random(12)
    docs = [{"d": f"d{i}", "text": piece(rng), "name": f"in/name{i}_doc.pdf", "page": i % 7, "context": f"the pump {i} was drained by crew {i % 9}", "box": [10.0, 10.0 + i, 200.0, 60.0 + i], "score": 0.8} for i in range(250)]
    queries = matching.planted(docs, 3)
    truth = {x["q"]: x["truth"] for x in queries}
    q = spark.createDataFrame([tuple(x[k] for k in ["q", *matching.ATTRIBUTES]) for x in queries], f"q string, {SIDE}")
    d = spark.createDataFrame([tuple(x[k] for k in ["d", *matching.ATTRIBUTES]) for x in docs], f"d string, {SIDE}")
    rows = matching.measured_pairs(matching.retrieve(q, d), q, d).collect()
    wanted = {k for k, v in truth.items() if v}
    assert len(wanted) > 100 and len({r.q for r in rows if truth[r.q] == r.d}) >= 0.99 * len(wanted)
    c, right = np.array([r.confidence for r in rows]), np.array([float(truth[r.q] == r.d) for r in rows])
    assert ((c - right) ** 2).mean() < 0.02
    table = matching.reliability(c, right)
    assert table[-1][1] > 0.97 and table[0][1] < 0.03 and sum(n for _, _, n in table) == len(rows)


def test_block_scores(monkeypatch):
    """Pruned scores are those of looking up everything, whether the documents of a text are few or many."""
    rng = np.random.default_rng(3)
    draw = lambda n, most: [np.unique(np.minimum(rng.zipf(1.3, k), most)) for k in rng.integers(0, 30, n)]
    code, of = draw(200, 300), np.sort(np.concatenate((np.arange(200), rng.integers(0, 12, 150))))
    other = [1000 + x for x in draw(350, 60)]
    sat = lambda bags: [rng.uniform(0.3, 2.2, len(b)).astype("float32") for b in bags]
    code_sat, other_sat = sat(code), sat(other)
    index = lambda bags, sats: matching.Postings(np.array([len(b) for b in bags]), np.concatenate(bags), np.concatenate(sats))
    block = matching.Block(index(code, code_sat), index(other, other_sat), [str(i) for i in range(350)], of)
    look = lambda bags, sats, x: np.array([s[b == x][0] if x in b else 0.0 for b, s in zip(bags, sats)])
    for own in (0, 2_000):
        monkeypatch.setattr(matching, "OWN_DOCUMENTS", own)
        for _ in range(60):
            t = np.concatenate((np.unique(np.minimum(rng.zipf(1.3, 25), 330)), 1000 + np.unique(np.minimum(rng.zipf(1.3, 8), 70))))
            is_code, idf = t < 1000, rng.uniform(0.2, 6, len(t))
            each = [look(code, code_sat, x) if c else look(other, other_sat, x) for x, c in zip(t, is_code)]
            most, floor = np.array([e.max() for e in each], "float32"), float(rng.uniform(0.5, 12))
            full = sum((w * e for w, e, c in zip(idf, each, is_code) if c), np.zeros(200))[of] + sum((w * e for w, e, c in zip(idf, each, is_code) if not c), np.zeros(350))
            best = {c: max(np.flatnonzero(of == c), key=lambda i: (round(full[i], 9), -i)) for c in range(200)}
            top = np.sort([full[i] for i in best.values()])[-2:]
            wanted = {i for i in best.values() if full[i] >= max(floor, min(top[0], (1 - matching.MARGIN) * top[1])) - 1e-9}
            docs, scores = block.best(t, idf, most, is_code, floor)
            assert set(docs) == wanted and np.allclose(scores, full[docs])
            assert not block.code.scores.any() and not block.attributes.scores.any()


def test_a_third_are_copies():
    """Queries of one text with very many copies cost no pass over the copies' code."""
    n = 60_000
    of = np.concatenate((np.zeros(n // 3, np.int64), np.arange(1, 2 * n // 3 + 1)))
    code = [np.arange(40)] + [np.array([100 + i, 200_000 + i % 977]) for i in range(2 * n // 3)]
    ones = lambda bags: np.ones(sum(map(len, bags)), "float32")
    names = [np.array([10**6 + i]) for i in range(n)]
    block = matching.Block(matching.Postings(np.array([len(b) for b in code]), np.concatenate(code), ones(code)), matching.Postings(np.ones(n, np.int64), np.concatenate(names), ones(names)), [str(i) for i in range(n)], of)
    start = time.time()
    for i in range(300):
        t = np.append(np.arange(40), 10**6 + i)
        docs, _ = block.best(t, np.full(41, 9.0), np.ones(41, "float32"), t < 1000, 5.0)
        assert list(docs) == [i]
    assert time.time() - start < 5
