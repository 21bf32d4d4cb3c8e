import itertools
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import lookalike
from foliospark.llm.lookalike import unify

ALPHABET = "ab C\n1²é" + "ȩ̣́̈ñÅÅﬁ​­ ‑–ｅаоΜρж"


def one_by_one(text):
    """By definition: the words of a text one after the other, their characters mapped, then canonical composition."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kind = lookalike.kind_of
    words = [list(w) for _, w in itertools.groupby(text, lambda c: kind(ord(c)) != lookalike.NONE)]
    has = lambda w, k: any(kind(ord(c)) == k for c in w)
    mixed = [has(w, lookalike.LATIN) and not has(w, lookalike.OTHER) for w in words]
    weigh = lambda c: lookalike.letters_in(ord(c)) * (kind(ord(c)) >= lookalike.LATIN)
    latin = sum(weigh(c) for w, m in zip(words, mixed) for c in w if m or kind(ord(c)) == lookalike.LATIN)
    mostly = 2 * latin >= sum(map(weigh, text))
    out = ""
    for w, m in zip(words, mixed):
        fold = m or (mostly and not has(w, lookalike.OTHER) and not has(w, lookalike.LIKE))
        out += "".join(chr(q) for c in w for q in lookalike.decomposed(ord(c), fold))
    return unicodedata.normalize("NFC", out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), max_size=5))
def test_against_one_by_one(texts):
    assert unify(texts) == [one_by_one(t) for t in texts]
    assert unify(unify(texts)) == unify(texts)


def test_seen_and_unseen():
    assert unify(["ｈｅｌｌｏ", "of­ﬁce", "a b", "Μ4‐L6 plain", "señal", "m²", "Straße Ä"]) == ["hello", "office", "a b", "M4-L6 plain", "señal", "m²", "Straße Ä"]
    assert len(set(unify(["a b", "a  b", "ab", "a\nb", "A b", "á b", "m2 b", "m² b"]))) == 8
    assert unify(["Привет мир", "сор"]) == ["Привет мир", "сор"]


def test_words_decide():
    """Symbols and words of another script stay, look-alikes within Latin words don't."""
    same = ["density ρ and pressure p", "angle α of it", "the word мир is Russian", "μ and Ω stay", "ışık"]
    assert unify(same) == same
    assert unify(["ѕcаlе", "vαlue", "sɡ", "a sсоре of it", "the а and the Ο", "ᎪᏢI call", "ꓓꓳꓖ days here", "оut"]) == ["scale", "value", "sg", "a scope of it", "the a and the O", "API call", "DOG days here", "out"]


def test_pairs(spark):
    base = "A reader sees this as one text"
    texts = {"c1": base, "c2": base, "r1-1-1": base.replace("e", "е"), "r1-1-2": base.replace(" ", " "), "r1-1-3": base.replace(" ", " "), "x": base.upper(), "s1": "short", "s2": "shоrt", "n": None, "e": ""}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [("c1", base, "clash")], "key string, text string, form string")
    got = {tuple(r) for r in lookalike.same_looking(df).collect()}
    want = {tuple(sorted((a, b))) for a in ("c1", "c2", "r1-1-1") for b in ("r1-1-2", "r1-1-3")} | {("c1", "r1-1-1"), ("c2", "r1-1-1")}
    assert got == want
    assert lookalike.same_looking(df.limit(0)).count() == 0
    classes = {r.key: (r["class"], r.n_links) for r in lookalike.classes(df).collect()}
    assert {k: v[1] for k, v in classes.items()} == {k: sum(k in pair for pair in want) for k in {x for pair in want for x in pair}} and len({v[0] for v in classes.values()}) == 1
    assert lookalike.classes(df.limit(0)).count() == 0
    form = {r.key: (r.text, r.changed) for r in lookalike.unified(df).collect()}
    assert form["r1-1-2"] == (base, True) and form["n"] == (None, False) and form["e"] == ("", False)


def test_rows_and_batches_agree(spark):
    """The forms rebuilt from exploded rows are those found within batches, for marks in any order, mixed words, surrogates and long texts."""
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET + "\r\t.α😀ⅸ", k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["e\u0301" * 3000 + " " + "ｗｉｄｅ " * 2000, "\u0301x", "\u200b", "a\r\nb\rc", "plain", "", "ﬁne ḍ̇ Å"]
    df = spark.createDataFrame([(f"k{i}", t, "clash") for i, t in enumerate(texts)] + [("n", None, "x"), ("k0", texts[0], "x")], "key string, text string, form string")
    got = {r.key: (r.text, r.changed) for r in lookalike.unified(df).collect()}
    assert got.pop("n") == (None, False) and len(got) == len(texts)
    assert [got[f"k{i}"][0] for i in range(len(texts))] == unify(texts)
    assert [got[f"k{i}"][1] for i in range(len(texts))] == [a != b for a, b in zip(unify(texts), texts)]
    assert lookalike.unified(df.limit(0)).count() == 0
