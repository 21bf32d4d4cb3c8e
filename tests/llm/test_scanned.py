import functools
import math
import random
import time

import pytest

from foliospark.llm import scanned
from foliospark.llm.scanned import Decoder, header_form, kinds_of, page_number_in, paragraphs, skeleton

WORDS = "the pump was drained and its valve reset before noon figure hopper spares carriage second torque through bearing column in yard turbine team".split()
DECODER = Decoder({w: 1000 for w in WORDS} | {"carnage": 1})


@pytest.mark.parametrize("seen,meant", [("h0pper", "hopper"), ("Fi9ure", "Figure"), ("sp@res", "spares"), ("secorid", "second"), ("Torqiie", "Torque"), ("tlirough", "through"), ("bcaring", "bearing"), ("colurnn", "column"), ("c0lurnn", "column"), ("Kandz0", "Kandzo"), ("PIIMP", "PIIMP"), ("hopper", "hopper"), ("KW-1276", "KW-1276"), ("52VM.29", "52VM.29"), ("rev2", "rev2"), ("Quilvo", "Quilvo"), ("x_1y", "x_1y"), ("a@b", "a@b")])
def test_words(seen, meant):
    assert DECODER.repair(seen).text == meant


def test_lattice():
    """Confusions, hyphens, gaps opened and closed compete in one reading."""
    read = lambda text: tuple(DECODER.repair(text))
    assert read("the tur-\nbine was dra‐\r\nined, by noon -\nand re\xad\nset") == ("the turbine was drained, by noon -\nand reset", 3, 0, 0)
    assert read("thepurnpwas") == ("the pump was", 0, 1, 2)
    assert read("pumpwasdrained") == ("pump was drained", 0, 0, 2) and read("quilvonumb") == ("quilvonumb", 0, 0, 0)
    assert read("and dra ined, the car riage and its tur bine") == ("and drained, the carriage and its turbine", 0, 0, 3)
    assert read("colu rnn") == ("column", 0, 1, 1) and read("the secori-\nd") == ("the second", 1, 1, 0)
    assert read("bear-\n  irig was tlirou-\ngh") == ("bearing was through", 2, 2, 0)
    assert read("the Quil-\nvo valve") == ("the Quilvo valve", 1, 0, 0) and read("KW-\n1276") == ("KW-\n1276", 0, 0, 0)


def test_hyphens_of_compounds():
    decoder = Decoder({w: 1000 for w in WORDS} | {"well-known": 500, "well": 900, "known": 900, "beside": 300, "be": 900, "side": 900})
    assert decoder.repair("a well-\nknown pump be-\nside it").text == "a well-known pump beside it"
    assert decoder.repair("a pump-\nvalve").text == "a pump-\nvalve"  # two words, no word together


def brute_force(words, text):
    """The cheapest reading of one chunk of small letters as words with gaps opened and confusions undone, by recursion over all splits."""
    total = sum(words.values())
    cost = {w: math.log(total / n) for w, n in words.items()}

    @functools.cache
    def forms(seen):
        if not seen:
            return {"": 0}
        out = {}
        for a, b in [*scanned.CONFUSIONS, (seen[0], seen[0])]:
            if seen.startswith(a):
                for rest, n in forms(seen[len(a) :]).items():
                    k = n + ((a, b) != (seen[0], seen[0]))
                    out[b.lower() + rest] = min(out.get(b.lower() + rest, 99), k)
        return out

    @functools.cache
    def best(at):
        if at == len(text):
            return 0.0
        found = [math.inf]
        for end in range(at + 1, len(text) + 1):
            inside = at > 0 or end < len(text)
            for w, n in forms(text[at:end]).items():
                if w in cost and (len(w) > 2 or not inside):
                    found.append(cost[w] + scanned.CONFUSED * n + (scanned.SPLIT if at else 0) + best(end))
        return min(found)

    return min(best(0), scanned.UNKNOWN + scanned.UNKNOWN_CHARACTER * len(text))


def test_against_brute_force():
    rng = random.Random(4)
    words = {w: rng.randint(1, 900) for w in ["the", "pump", "drain", "drained", "warn", "worn", "arm", "dan", "clan", "in", "burn", "bum", "corner", "comer", "hum"]}
    decoder = Decoder(words)
    words = {w: n for w, n in words.items() if w in decoder.cost}
    for _ in range(300):
        text = "".join(rng.choice(list(words)) for _ in range(rng.randint(1, 3)))
        for a, b in rng.sample([c for c in scanned.CONFUSIONS if c[0].isalpha() and c[0].islower()], 4):
            if rng.random() < 0.5:
                text = text.replace(b.lower(), a, 1)
        if len(text) > 2 and text not in decoder.cost:
            got = decoder.decode(text)
            parts = got.text.split(" ")
            cost = scanned.UNKNOWN + scanned.UNKNOWN_CHARACTER * len(text) if got.text == text else sum(decoder.cost[p] for p in parts) + scanned.CONFUSED * got.undone + scanned.SPLIT * (len(parts) - 1)
            assert cost == pytest.approx(brute_force(words, text)), text


def test_long_texts():
    text = "pumpwasdrained" * 3000 + " " + "quilvo-\n" * 3000 + "9" * 5000
    start = time.time()
    assert DECODER.repair(text).breaks > 2000 and time.time() - start < 20


def test_page_numbers():
    for text in ("7", "- 7 -", "~ 7 ~", "[7]", "Page 7", "Pa9e 7", "Page 7 of 9", "Sheet 7/9", "p. 7", "Pg 7", "7 / 9", "vii"):
        assert page_number_in(text) == 7, text
    for text in ("", "7 pumps", "Section 7.2", "7.2", "x7", "mix 7"):
        assert page_number_in(text) is None


def test_headers():
    assert header_form("3.12 | Rcmsia annu@l belt mariual") == header_form("REMSIA ANNUAL BELT MANUAL   4") == skeleton("Remsia annual belt manual")
    record = [(1, "header", "Remsia annual belt manual"), (1, "title", "Remsia annual belt manual"), (1, "para", "Text"), (2, "sec", "4.1 | Remsia annual belt manual"), (2, "foot", "2"), (2, "code", "2"), (3, None, "2")]
    assert kinds_of(record, None) == ["header", "", "", "header", "number", "", ""]
    unnamed = [(1, "sec", "Remsia annual belt manual"), (2, "sec", "Remsia annual belt manual")]
    assert kinds_of(unnamed, "in/remsia_annual_belt_manual_v8_4240.pdf") == ["", "header"]


def test_paragraphs():
    lines = ["The pump was drained", "and reset.", "The valve", "stood open.", "- an item"]
    assert paragraphs(lines, [True, False, True, False, True]) == ["The pump was drained and reset.", "The valve stood open.", "- an item"]
    assert paragraphs(["It goes on", "over two elements."], [True, True]) == ["It goes on over two elements."] and paragraphs([], []) == []
    assert paragraphs(["A title", "The text", "goes on"], [1, 2, 0]) == ["A title", "The text goes on"]


def test_spark(spark):
    text = "the pump was drained and its valve reset before noon\nin the yard. "
    schema = "rec_id bigint, source_file string, pages array<struct<page_number:int,elements:array<struct<label:string,text:string,reading_order:int>>>>, kind string"
    rows = [
        (1, None, [(1, [("title", "The yard team", 0), None, ("para", text * 5, 1), ("para", "the p0mp", 3), ("para", "the ya-\nrd and", 2), ("code", "ya-\nrd", 4), (None, None, 5), ("foot", "", 6)]), (2, [("header", "THE YARD TEAM", 0), ("foot", "- 2 -", 1), ("para", "Its va1ve.", None)]), (3, None)], "x"),
        (2, None, None, "x"), (3, "f", [], "x"), (None, None, [(1, [("para", "the yard", 0)])], "x"),
    ]
    df = spark.createDataFrame(rows + rows[:1], schema)
    got = {(r.rec_id, r.page_number, r.elem_no): (r.kind, r.breaks, r.confusions) for r in scanned.repaired(df, "elements").collect()}
    assert got == {(1, 1, 4): ("text", 1, 0), (1, 2, 1): ("header", 0, 0), (1, 2, 2): ("number", 0, 0), (1, 2, 3): ("text", 0, 1)}
    page = [r.text for r in sorted(scanned.repaired(df, "paragraphs").where("rec_id = 1 and page_number = 2").collect(), key=lambda r: r.para_no)]
    assert page == ["Its valve."]
    assert scanned.repaired(df.limit(0), "elements").count() == 0 and scanned.repaired(df.limit(0), "paragraphs").count() == 0
