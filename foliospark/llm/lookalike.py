"""One consistent form for text that reads the same but is written with other characters.

Texts are exploded to positioned code points, which are joined with a mapping of the code points that occur: their kind,
their visible parts, the letter that they look like. Marks are ordered by class within their cluster, clusters are
recomposed, and the strings are rebuilt. Texts that are all ASCII (with line feeds only) are in that form already; of the
others only the words that aren't ASCII are exploded, the words between them are rows of their own.

What a reader sees is kept: letter case, accents, digits, raised digits, line breaks, the number and place of spaces.
What a reader doesn't see is unified: kinds of spaces and hyphens, invisible characters, joined letters, wide
forms, and look-alike letters. These are decided word by word: in a word with Latin letters all look-alikes are
folded, in a word of look-alikes alone only those of the very same shape, and only in texts whose letters are mostly Latin; a
word with any other foreign letter stays. So a symbol such as a single rho or alpha isn't taken for a letter.

`unify` gives the same form within a batch, for operators that need it beside other work on texts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.runtime import materialize, measured_join

#: Letters of other scripts, and the Latin letters that have the same shape.
SAME_SHAPE = [
    ("аеорсухіјѕԁһԛԝАВЕЅІЈКМНОРСТУХҮԌԚԜ", "aeopcyxijsdhqwABESIJKMHOPCTYXYGQW"),  # Cyrillic
    ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "oABEZHIKMNOPTYXcj"),  # Greek
    ("օսհոՕՍԼ", "ouhnOUL"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4VSLCPKB"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
]
#: Letters that look the same within a word only.
LIKE_SHAPE = [("т", "t"), ("ανιρυκτ", "avipukt"), ("ɑɡɩ", "agi")]
#: Hyphens, and line ends that are shown as a line feed.
HYPHENS = "‐‑‒﹣－᠆⁃"
GROUP_CHARS = 4_000_000
MIN_CHARS = 20


@lru_cache(maxsize=1)
def lookalikes() -> dict[int, str]:
    return {ord(a): b for pair in (*SAME_SHAPE, *LIKE_SHAPE) for a, b in zip(*pair)}


@lru_cache(maxsize=1)
def same_shapes() -> frozenset[int]:
    return frozenset(ord(a) for pair in SAME_SHAPE for a in pair[0])


@lru_cache(maxsize=200_000)
def decomposed(code: int, fold: bool) -> tuple[int, ...]:
    """Code points that stand for one: nothing if it's invisible, else its visible parts, marks apart."""
    c = chr(code)
    if 0xD800 <= code < 0xE000:
        return (code,)
    if fold and code in lookalikes():
        return (ord(lookalikes()[code]),)
    if c in HYPHENS:
        return (0x2D,)
    category = unicodedata.category(c)
    if category == "Zs":
        return (0x20,)
    if category == "Cf" or 0xFE00 <= code <= 0xFE0F or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164):
        return ()
    kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
    if not rest:
        return (code,)
    parts = [int(x, 16) for x in rest.split()]
    if kind in ("", "<wide", "<narrow", "<font", "<noBreak") or (kind == "<compat" and all(unicodedata.category(chr(p))[0] == "L" for p in parts)):
        return tuple(q for p in parts for q in decomposed(p, fold))
    return (code,)


@lru_cache(maxsize=200_000)
def composed(a: int, b: int) -> int:
    """The one code point that a base and a mark make, or 0."""
    c = unicodedata.normalize("NFC", chr(a) + chr(b))
    return ord(c) if len(c) == 1 else 0


def table(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mapped code points of each pair of code and kind (1: look-alikes are folded), and how many each gives."""
    both, inverse = np.unique(codes.astype(np.int64) * 2 + kinds, return_inverse=True)
    lists = [decomposed(int(x) >> 1, bool(x & 1)) for x in both]
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.array([q for x in lists for q in x], np.int64)
    start = np.cumsum(size) - size
    count = size[inverse]
    at = np.repeat(start[inverse] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return flat[at] if len(flat) else np.zeros(0, np.int64), count


def by_code(codes: np.ndarray, of) -> np.ndarray:
    known, inverse = np.unique(codes, return_inverse=True)
    return np.array([of(int(x)) for x in known], np.int64)[inverse] if len(known) else np.zeros(0, np.int64)


#: Kinds of code points: no letter, part of a word without being a letter, Latin letter, look-alike of the same shape, other look-alike, other letter.
NONE, PART, LATIN, SAME, LIKE, OTHER = range(6)


def kind_of(code: int) -> int:
    if 0xD800 <= code < 0xE000:
        return NONE
    parts = decomposed(code, False)
    kinds = [(SAME if q in same_shapes() else LIKE) if q in lookalikes() else LATIN if unicodedata.name(chr(q), "").startswith("LATIN") else OTHER for q in parts if chr(q).isalpha()]
    return max(kinds) if kinds else PART if not parts or unicodedata.combining(chr(parts[0])) else NONE


def letters_in(code: int) -> int:
    """How many letters a code point's parts are."""
    return 0 if 0xD800 <= code < 0xE000 else sum(chr(q).isalpha() for q in decomposed(code, False))


def folded(codes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Which code points stand in a word whose look-alikes are folded."""
    kind = by_code(codes, kind_of)
    inside = kind != NONE
    new = np.ones(len(codes), bool)
    new[1:] = (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    word = np.cumsum(new) - 1
    has = lambda k: np.bincount(word, kind == k) > 0
    mixed = ~has(OTHER) & has(LATIN)
    latin = (kind == LATIN) | (mixed[word] & (kind >= SAME))
    letters = by_code(codes, letters_in)
    mostly = np.bincount(text, letters * latin, n_texts) >= np.bincount(text, letters * ((kind >= SAME) & ~latin), n_texts)
    return (mixed | (~has(OTHER) & ~has(LIKE) & mostly[text[new]]))[word] & inside


def compose(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the marks of each cluster by class, then join them to their base one after the other."""
    mark = by_code(codes, lambda x: 0 if 0xD800 <= x < 0xE000 else unicodedata.combining(chr(x)))
    if not mark.any():
        return codes, text
    new = mark == 0
    new[1:] |= text[1:] != text[:-1]
    new[0] = True
    cluster = np.cumsum(new) - 1
    order = np.lexsort((np.arange(len(codes)), mark, cluster))
    codes, mark, text = codes[order].copy(), mark[order], text[order]
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(codes)))
    keep = np.ones(len(codes), bool)
    last = np.zeros(len(head), np.int64)  # class of the last mark that stayed
    for k in range(1, int(length.max())):
        live = np.flatnonzero((length > k) & (mark[head] == 0))
        base, at = head[live], head[live] + k
        pairs, inverse = np.unique(np.stack([codes[base], codes[at]], 1), axis=0, return_inverse=True)
        made = np.array([composed(int(a), int(b)) for a, b in pairs], np.int64)[inverse.ravel()]
        joined = (made > 0) & (last[live] < mark[at])
        codes[base[joined]] = made[joined]
        keep[at[joined]] = False
        last[live[~joined]] = mark[at[~joined]]
    return codes[keep], text[keep]


def unify(texts: list[str]) -> list[str]:
    """The consistent form of each text."""
    out = list(texts)
    hard = [i for i, t in enumerate(texts) if "\r" in t or not t.isascii()]
    start = 0
    while start < len(hard):
        stop, total = start, 0
        while stop < len(hard) and (stop == start or total + len(texts[hard[stop]]) <= GROUP_CHARS):
            total += len(texts[hard[stop]])
            stop += 1
        group = hard[start:stop]
        start = stop
        raw = [texts[i].replace("\r\n", "\n").replace("\r", "\n") for i in group]
        size = np.array([len(t) for t in raw])
        codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        text = np.repeat(np.arange(len(raw)), size)
        codes, count = table(codes, folded(codes, text, len(raw)).astype(np.int64))
        codes, text = compose(codes, np.repeat(text, count))
        whole = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(text, minlength=len(raw)))
        for i, a, b in zip(group, np.append(0, ends[:-1]), ends):
            out[i] = whole[a:b]
    return out


NOT_ASCII = r"[^\x00-\x7F]"


def is_hard(text: Column) -> Column:
    """Whether a text must be exploded: it has other than ASCII, or line ends other than line feeds."""
    return text.rlike(NOT_ASCII + r"|\r")


def mapping(texts: DataFrame) -> DataFrame:
    """(ch, kind, letters, plain, folded): kind, number of letters and parts (character, class of mark) of each code point that occurs, and of ASCII.

    There are at most 1,114,112 code points, so the table is bounded whatever the corpus; it is made on the driver.
    """
    there = texts.where(F.col("text").rlike(NOT_ASCII)).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NOT_ASCII), F.lit(0)))).alias("ch")).distinct()
    codes = {ord(r.ch) for r in there.collect()} | set(range(128))
    part = lambda q: (chr(q), unicodedata.combining(chr(q)))
    rows = [(chr(c), kind_of(c), letters_in(c), [part(q) for q in decomposed(c, False)], [part(q) for q in decomposed(c, True)]) for c in sorted(codes)]
    parts = "array<struct<c: string, mark: int>>"
    return texts.sparkSession.createDataFrame(rows, f"ch string, kind int, letters int, plain {parts}, folded {parts}")


def pieces(text: Column) -> Column:
    """A text's pieces in order: words of ASCII with the space or line feed behind them, and the code points of other words."""
    words = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), r"(?<=[ \n])", -1)
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(NOT_ASCII), F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))


def rebuilt(hard: DataFrame) -> DataFrame:
    """(key, form): the consistent form of texts (key, text) with unique keys. One shuffle, by key, serves all steps."""
    rows = hard.select("key", F.posexplode(pieces(F.col("text"))).alias("pos", "ch"))
    known = rows.join(F.broadcast(mapping(hard)), "ch", "left")  # bounded by the number of code points there are
    kind = F.coalesce("kind", F.lit(NONE))
    text = Window.partitionBy("key")
    order, word = text.orderBy("pos"), Window.partitionBy("key", "word")
    inside = kind != NONE
    edge = F.coalesce(inside != F.lag(inside).over(order), F.lit(True))
    marked = known.withColumns({"kind": kind, "edge": edge}).withColumn("word", F.sum(F.col("edge").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    has = lambda k: F.max(F.col("kind") == k).over(word)
    flagged = marked.withColumns({"other": has(OTHER), "latin": has(LATIN), "like": has(LIKE)}).withColumn("mixed", F.col("latin") & ~F.col("other"))
    foreign = F.col("kind") >= SAME
    latin = F.when(F.col("letters").isNull(), F.length(F.regexp_replace("ch", "[^A-Za-z]", ""))).when((F.col("kind") == LATIN) | (F.col("mixed") & foreign), F.col("letters")).when(foreign, -F.col("letters")).otherwise(0)
    mostly = F.sum(latin).over(text) >= 0
    fold = (F.col("kind") != NONE) & (F.col("mixed") | (~F.col("other") & ~F.col("like") & mostly))
    parts = F.when(F.col("plain").isNull(), F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("mark")))).when(fold, F.col("folded")).otherwise(F.col("plain"))
    said = flagged.select("key", "pos", parts.alias("parts")).select("key", "pos", F.posexplode("parts").alias("at", "part"))
    place = Window.partitionBy("key").orderBy("pos", "at").rowsBetween(Window.unboundedPreceding, 0)
    clustered = said.withColumn("cluster", F.sum((F.col("part.mark") == 0).cast("int")).over(place))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("part.mark").alias("mark"), "pos", "at", F.col("part.c").alias("c"))))
    clusters = clustered.groupBy("key", "cluster").agg(sorted_.alias("parts"))

    def compose(several: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in several.to_pylist()], pa.string())

    joined = F.array_join(F.transform("parts", lambda x: x["c"]), "")
    whole = clusters.withColumn("s", F.coalesce(F.arrow_udf(compose, "string")(F.when(F.size("parts") > 1, joined)), joined))
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "s"))), lambda x: x["s"]), "")
    return whole.groupBy("key").agg(form.alias("form"))


def unified(texts: DataFrame) -> DataFrame:
    """(key, text, changed): the text of each key in the consistent form, and whether that differs from what was given.

    Rows delivered twice (equal keys) count once. Null texts stay null, empty ones empty; a text of nothing but invisible
    characters becomes empty. Other columns are ignored, and an empty table gives an empty one.
    """
    given = texts.select("key", "text")
    hard = given.where(is_hard(F.col("text"))).dropDuplicates(["key"])  # copies are equal, so each kind is freed of its own: what isn't exploded is shuffled once
    forms = hard.select("key", F.col("text").alias("given")).join(rebuilt(hard), "key", "left").select("key", F.coalesce("form", F.lit("")).alias("text"), "given")
    easy = given.where(~F.coalesce(is_hard(F.col("text")), F.lit(False))).dropDuplicates(["key"])
    return easy.select("key", "text", F.lit(False).alias("changed")).unionByName(forms.select("key", "text", (F.col("text") != F.col("given")).alias("changed")))


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def fingerprints(texts: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(key, form, raw, changed) of texts long enough: digests of the consistent form and of the text itself. The texts that were exploded, materialized, and the others."""
    long = texts.select("key", "text").where(F.length("text") >= min_chars)
    hard = long.where(is_hard(F.col("text"))).dropDuplicates(["key"])
    forms = hard.select("key", digest(F.col("text")).alias("raw")).join(rebuilt(hard), "key", "left").select("key", digest(F.coalesce("form", F.lit(""))).alias("form"), "raw")
    easy = long.where(~is_hard(F.col("text"))).select("key", digest(F.col("text")).alias("form"))
    return materialize(forms.withColumn("changed", F.col("form") != F.col("raw"))), easy.withColumns({"raw": F.col("form"), "changed": F.lit(False)})


def classes(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, class, n_links): texts that look the same as another one without being equal, with their class and the number of such others.

    One row for each text however many look the same: the links of a text are its class less the exact copies of it.
    """
    hard, easy = fingerprints(texts, min_chars)
    prints = hard.unionByName(easy.dropDuplicates(["key"])).select("key", "form", "raw")
    copies = prints.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = copies.groupBy("form").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("form", "all")
    links = materialize(copies.join(several, "form").select("form", "raw", (F.col("all") - F.col("n")).alias("n_links")))
    return measured_join(prints, links, ["form", "raw"]).select("key", F.lower(F.hex("form")).alias("class"), "n_links")


def same_looking(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key_a, key_b): texts with one consistent form that aren't equal; key_a is the smaller.

    Texts: key (unique but for rows delivered twice), text; null and shorter texts are in no pair. At least one of a
    pair was changed by the form, so only forms of changed texts are looked up: exact copies of plain text, however
    many, never meet. Pairs are between distinct texts of one form, each then with its keys.
    """
    hard, easy = fingerprints(texts, min_chars)
    changed = hard.where("changed").select("key", "form", "raw")
    wanted = materialize(changed.select("form").distinct())
    plain = measured_join(hard.where("not changed").unionByName(easy).select("key", "form"), wanted, ["form"], "left_semi").dropDuplicates(["key"])
    plain = plain.select("form", F.col("key").alias("k2"))
    right = changed.select("form", F.col("key").alias("k2"), F.col("raw").alias("r2"))
    to_plain = changed.select("form", F.col("key").alias("k1")).join(plain, "form").select("k1", "k2")
    classes = changed.groupBy("form").agg(F.countDistinct("raw").alias("n")).where("n > 1").select("form")
    several = changed.join(classes, "form", "left_semi").select("form", F.col("key").alias("k1"), F.col("raw").alias("r1"))
    to_changed = several.join(right, "form").where((F.col("r1") != F.col("r2")) & (F.col("k1") < F.col("k2"))).select("k1", "k2")
    return to_plain.unionByName(to_changed).select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))
