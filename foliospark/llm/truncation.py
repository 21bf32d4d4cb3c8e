"""Texts cut off by field limits or broken transfers.

Lengths are recomputed under several encodings (characters, UTF-8 bytes, UTF-16 units, entity escaping, JSON escaping
with letters kept or as ASCII, CR LF line ends) and grouped by source: a length that far more distinct texts have than its neighbourhood is a
hidden storage limit. Of the encodings that show limits of a source, the one that explains most texts is the one its field is
measured in. Then the endings are inspected: an ending is complete, cut, or open to doubt (a heading-like
line, a list item, dots of its own or of a cut). Doubt is settled by the limits, by the corpus's own words (a last
word that is rare but begins a frequent one is a part of a word) and by the forms of list items that occur elsewhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.runtime import materialize, measured_join

#: A limit is a length of at least so many distinct texts of a source, and so many times the mean of the lengths within NEAR,
#: at least LIMIT_OPEN of which don't end as a complete text does.
LIMIT_TEXTS = 5
LIMIT_TIMES = 8
LIMIT_OPEN = 0.7
NEAR = 50
#: A word part: a last word that is at most such a share of all words elsewhere, and begins a word of at least such a share. In
#: small corpora these counts hold.
RARE_SHARE, RARE_WORD = 1e-6, 2
COMMON_SHARE, COMMON_WORD = 1e-5, 20
#: Forms of list items that make up at least this share of all are complete forms.
FORM_SHARE = 0.004

VARIANTS = ["chars", "bytes", "utf16", "entities", "json", "crlf", "entity_bytes", "crlf_bytes", "json_ascii", "json_bytes"]
#: Characters that JSON escapes with a letter, and control characters that it escapes by their number.
SHORT_ESCAPES = re.compile(r'["\\\n\t\r\b\f]')
LONG_ESCAPES = re.compile(r"[\x00-\x07\x0b\x0e-\x1f]")
WORD = re.compile(r"[^\W\d_]+")
ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+(.*)$")
#: Words after which a phrase goes on.
OPEN_WORDS = frozenset(
    "a an the of to for in on at by with from and or but its it is was were be been has have that which when if as unless until while because though where "
    "le la les l un une des du de d à et ou en dès avant selon "
    "der die das den dem des ein eine und oder im in am bei nach während gemäß "
    "el los las una y o en con sin antes según al del".split()
)
LABEL = re.compile(r"[^\W\d_][\w .-]{0,40}: \S")
TAIL = re.compile(r", [^\W\d_]+(?: [\d.:/-]+)?$")
CLOSERS = {")": "(", "]": "[", "»": "«", "”": "“"}
FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)


def json_escapes(text: str) -> int:
    return len(SHORT_ESCAPES.findall(text)) + 5 * len(LONG_ESCAPES.findall(text))


def lengths(text: str) -> list[int]:
    n, size = len(text), len(text.encode("utf-8", "surrogatepass"))
    utf16 = n + sum(1 for c in text if c > "\uffff") if size > n else n
    entity = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * text.count('"') + 5 * text.count("'")
    lines = text.count("\n")
    return [n, size, utf16, n + entity, n + json_escapes(text), n + lines, size + entity, size + lines]


def json_lengths(text: str) -> list[int]:
    """Lengths as JSON with all but ASCII escaped, and as JSON in bytes."""
    n, size, escapes = len(text), len(text.encode("utf-8", "surrogatepass")), json_escapes(text)
    units = len(text.encode("utf-16-le", "surrogatepass")) // 2 if size > n else n
    plain = len(text.encode("ascii", "ignore")) if size > n else n
    return [plain + 6 * (units - plain) + escapes, size + escapes]


def item_form(item: str) -> str:
    """The form of a list item: its numbers, codes and words by kind."""
    form = re.sub(r"\([^()]*\)", "P", item)
    form = re.sub(r"\b(?=\w*\d)[\w.-]*\w", "N", form)
    form = re.sub(r"\bthe\b", "T", form)
    form = re.sub(r"\b[A-ZÀ-Þ][\w'-]*(?<![PNT])\b", "C", form)
    return re.sub(r"\b[a-zµ°%ß-ÿ][\w'/-]*", "w", form)


def last_word(text: str) -> str:
    at = len(text)
    while at and text[at - 1].isalpha():
        at -= 1
    return text[at:]


def heading_like(line: str) -> bool:
    """A line that is no sentence: a heading, a label with its value, a chain, or a title with a number or place."""
    if line.startswith("#"):
        return True
    if last_word(line).lower() in OPEN_WORDS or line[-1] in ",;:-/>&(":
        return False
    if re.match(r"[^\W\d_]*", line).group().lower() in OPEN_WORDS:
        return False
    return bool(LABEL.match(line) or " -> " in line or " / " in line or TAIL.search(line) or re.fullmatch(r"(?:[^\W\d_]+ ){2,4}[\d.]+", line))


def ending(text: str) -> tuple[str, str, str]:
    """(kind, last word, form of a list item) of a text that isn't blank. Kinds: complete, cut, heading, item, dots."""
    body = text.rstrip()
    line = body.rsplit("\n", 1)[-1]
    if body[-1] == "�":
        return "cut", "", ""
    if len(FENCE.findall(body)) % 2:
        return "cut", "", ""
    if FENCE.match(line):
        return "complete", "", ""
    if re.fullmatch(r"`{1,2}", line.strip()):
        return "cut", "", ""
    bare = body.rstrip(".…")
    if len(body) - len(bare) > 1 or body[-1] == "…":
        return "dots", last_word(bare.rstrip()), ""
    if line.lstrip().startswith("|"):
        if not line.endswith("|"):
            return "cut", "", ""
        rows = []
        for row in reversed(body.split("\n")):
            if not row.lstrip().startswith("|"):
                break
            rows.append(row.count("|") - row.count("\\|"))
        return ("cut" if rows[0] < rows[-1] else "complete"), "", ""
    item = ITEM.match(line)
    if item and item.group(1) and item.group(1)[-1] not in ".!?":
        return "item", last_word(line), item_form(item.group(1))
    if re.fullmatch(r"\s*(?:[-*•]|\d+[.)])\s*", line):
        return "cut", "", ""
    opener = CLOSERS.get(line[-1], line[-1] if line[-1] in "\"'" else "")
    if opener:
        even = line.count(line[-1]) <= line.count(opener) if opener != line[-1] else line.count(opener) % 2 == 0
        whole = line[0] == opener or line[-2:-1] in tuple(".!?…") or heading_like(line[:-1] + "x")
        return ("complete" if even and whole else "cut"), "", ""
    if line[-1] == ".":
        head = line[:-1].rstrip("0123456789")
        return ("stop" if len(head) < len(line) - 1 and (not head or head[-1].isspace()) else "complete"), "", ""
    if line[-1] in "!?。！？":
        return "complete", "", ""
    if not re.search(r"[.!?][\"')]? +\S", line) and heading_like(line):
        return "heading", last_word(line), ""
    if re.search(r"[\u3040-\u9fff]$", line) or unicodedata.category(line[-1])[0] == "S":
        return "heading", "", ""
    return "cut", last_word(line), ""


def inspected(documents: DataFrame) -> DataFrame:
    """(doc_id, source, h: hash of the text, lengths under VARIANTS, kind, last word, form of a list item) of every text that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, source, text in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                if text and not text.isspace():
                    kind, word, form = ending(text)
                    rows.append((doc, source, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), lengths(text) + json_lengths(text), kind, word, form))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.record_batch({
                "doc_id": pa.array(cols[0], pa.int64()), "source": pa.array(cols[1], pa.string()), "h": pa.array(cols[2], pa.int64()), "lengths": pa.array(cols[3], pa.list_(pa.int32())),
                "kind": pa.array(cols[4], pa.string()), "word": pa.array(cols[5], pa.string()), "form": pa.array(cols[6], pa.string()),
            })

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, h bigint, lengths array<int>, kind string, word string, form string")


def corpus_words(documents: DataFrame) -> DataFrame:
    """(kind, value, n): words but for each text's last one, and forms of list items but for a text's last line; summed per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            forms: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(WORD.findall(text)[:-1])
                    for line in text.rstrip().split("\n")[:-1]:
                        if line[:1] in "-*• 0123456789" and (m := ITEM.match(line)):
                            forms[item_form(m.group(1))] += 1
            yield pa.record_batch({
                "kind": pa.array(["word"] * len(words) + ["form"] * len(forms), pa.string()), "value": pa.array([*words, *forms], pa.string()), "n": pa.array([*words.values(), *forms.values()], pa.int64()),
            })

    return documents.select("text").mapInArrow(run, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))


class Truncation:
    """Cut texts and the limits they show.

    documents: doc_id (unique), source, text. Null, empty and blank texts are never cut; a null source is a source of its own.
    Repeated texts count once in finding limits, and are each reported. Extra columns are ignored.
    """

    def __init__(self, documents: DataFrame):
        self.documents = documents
        self.rows = materialize(inspected(documents))

    def limits(self) -> DataFrame:
        """(source, variant, length, texts): lengths that far more distinct texts have than those near them, in the encoding that explains most texts of the source (of equals the first of VARIANTS)."""
        each = self.rows.select(F.coalesce("source", F.lit("")).alias("source"), "h", F.col("kind").isin("cut", "dots").cast("int").alias("open"), F.posexplode("lengths").alias("v", "length"))
        counts = each.groupBy("source", "v", "length", "h").agg(F.max("open").alias("open")).groupBy("source", "v", "length").agg(F.count(F.lit(1)).alias("texts"), F.sum("open").alias("open"))
        counts = materialize(counts)
        peaks = counts.where((F.col("texts") >= LIMIT_TEXTS) & (F.col("open") >= LIMIT_OPEN * F.col("texts")))
        # each length counts for the peaks within NEAR of it: the peak is looked up in the three cells around it
        cell = F.floor(F.col("length") / (NEAR + 1))
        cells = peaks.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).select("source", "v", "cell", F.col("length").alias("peak"), F.col("texts").alias("peak_texts"))
        near = counts.withColumn("cell", cell).join(cells, ["source", "v", "cell"]).where(F.abs(F.col("length") - F.col("peak")) <= NEAR)
        sums = near.groupBy("source", "v", "peak", "peak_texts").agg(F.sum("texts").alias("all"))
        kept = sums.where(F.col("peak_texts") * (2 * NEAR) >= LIMIT_TIMES * (F.col("all") - F.col("peak_texts")))
        best = Window.partitionBy("source").orderBy(F.desc("explained"), "v")
        chosen = kept.groupBy("source", "v").agg(F.sum("peak_texts").alias("explained")).withColumn("rank", F.row_number().over(best)).where("rank = 1")
        kept = kept.join(chosen.select("source", "v"), ["source", "v"], "left_semi")
        return kept.select("source", F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("v") + 1).alias("variant"), F.col("v"), F.col("peak").alias("length"), F.col("peak_texts").alias("texts"))

    def doubtful(self) -> DataFrame:
        """Rows open to doubt, with at_limit, word_part and known_form."""
        rows = self.rows.where(F.col("kind").isin("heading", "item", "dots", "stop"))
        limits = materialize(self.limits())
        places = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.posexplode("lengths").alias("v", "length"))
        at_limit = measured_join(places, limits.select("source", "v", "length"), ["source", "v", "length"], "left_semi").select("doc_id").distinct()
        counts = materialize(corpus_words(self.documents))
        words = counts.where("kind = 'word'").select(F.col("value").alias("word"), "n")
        all_words = words.agg(F.sum("n")).first()[0] or 0
        rare, common = max(RARE_WORD, RARE_SHARE * all_words), max(COMMON_WORD, COMMON_SHARE * all_words)
        long = words.where(F.col("n") >= common)  # at most 1 / COMMON_SHARE words
        heads = long.select(F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, 1, i))")).alias("word")).distinct()
        last = rows.where("word <> ''").select("word").distinct()
        parts = last.join(heads, "word", "left_semi").join(words.where(F.col("n") > rare), "word", "left_anti")
        forms = counts.where("kind = 'form'").select(F.col("value").alias("form"), "n")
        total = forms.agg(F.sum("n").alias("total"))
        known = forms.join(F.broadcast(total)).where(F.col("n") >= FORM_SHARE * F.col("total")).select("form")  # one row
        flagged = rows.join(at_limit.withColumn("at_limit", F.lit(True)), "doc_id", "left")
        flagged = measured_join(flagged, materialize(parts.withColumn("word_part", F.lit(True))), ["word"], "left")
        return measured_join(flagged, materialize(known.withColumn("known_form", F.lit(True))), ["form"], "left")

    def found(self) -> DataFrame:
        """(doc_id): every cut text."""
        no = lambda c: F.coalesce(c, F.lit(False))
        kind, at, part, form = F.col("kind"), no("at_limit"), no("word_part"), no("known_form")
        cut = ((kind == "heading") & (at | part)) | ((kind == "item") & (part | ~form)) | ((kind == "dots") & (at | part)) | ((kind == "stop") & at)
        return self.rows.where("kind = 'cut'").select("doc_id").unionByName(self.doubtful().where(cut).select("doc_id"))

    def sources(self) -> DataFrame:
        """(source, texts, cut, share): how often each source truncates."""
        cut = self.found().withColumn("cut", F.lit(1))
        joined = self.rows.select("doc_id", "source").join(cut, "doc_id", "left")
        return joined.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count("cut").alias("cut"), (F.count("cut") / F.count(F.lit(1))).alias("share"))
