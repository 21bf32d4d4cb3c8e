"""Text from scanned pages, repaired into continuous paragraphs.

A noisy channel turns words into what stands in the text: characters are confused, words are broken across lines by
hyphens, split or run together, and the page's running header and number stand as elements of their own. The decoder
reads the text without its line ends as one stream: a lattice of the lexicon's words as they stand, with confusions
undone, with a hyphen and its line end dropped or kept, with gaps closed within them or opened between them; the cheapest
path wins (Viterbi), and what it undid tells which elements are cases. The lexicon
is the corpus's own: words of at least LEXICON_SHARE of all words, so it can't hold more than 1 / LEXICON_SHARE words
and may travel to all workers. Paragraph boundaries are chosen by dynamic programming over the lines of a page.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.nested import child_index, column, field

#: A word of the lexicon makes up at least this share of all words, and occurs at least LEXICON_COUNT times.
LEXICON_SHARE = 2e-5
LEXICON_COUNT = 3
#: What recognition takes characters for, as (seen, meant).
CONFUSIONS = [
    ("c", "e"), ("@", "a"), ("f", "t"), ("0", "o"), ("!", "i"), ("ri", "n"), ("1", "l"), ("5", "s"), ("cl", "d"), ("ii", "u"), ("9", "g"), ("li", "h"), ("rn", "m"),
    ("6", "b"), ("vv", "w"), ("U", "ll"), ("m", "rn"), ("d", "cl"), ("8", "B"), ("2", "z"),
]
SYMBOLS = "0123456789@!"
#: What may be meant by what begins with a character.
MEANT = {c: [(a, b.lower()) for a, b in CONFUSIONS if a[0] == c] for c in {a[0] for a, _ in CONFUSIONS}}
#: Costs of the decoder, in nats: a confusion (in a capitalised word every one after the first), a hyphen dropped at a line's
#: end, one kept there, a gap opened or closed; a piece that is no word, and each of its characters, for names and others.
CONFUSED, CONFUSED_NAME, HYPHEN, KEPT, SPLIT = 3.0, 6.0, 1.0, 8.0, 6.0
NAME, NAME_CHARACTER, UNKNOWN, UNKNOWN_CHARACTER = 10.0, 0.75, 14.0, 2.0
#: A piece that is no word is joined to the next line's until it has more characters than this. Readings of longer stretches aren't remembered.
LONGEST_WORD = 100
REMEMBERED = 200
#: A frequent word is itself a misreading if undoing one confusion gives a word so many times as frequent.
MISREAD_TIMES = 50
#: Labels of running text; what has another label is a paragraph of its own.
RUNNING = frozenset(("para", None))
SKIPPED_LABELS = frozenset(("code", "tab", "fig"))

HYPHENS = "-‐‑\u00ad"
LINE_HYPHEN = re.compile(r"[-‐‑\u00ad][ \t]*\r?\n[ \t]*(?=\w)")
SPACE = re.compile(r"\s+")
CHUNK = re.compile(r"\S+")
EDGES = ".,;:!?()[]{}\"'“”«»…*•|<>/\\=~"
#: What words are made of in a chunk: no punctuation around them, no dash or slash between them.
ATOM = re.compile(r"[^\s.,;:!?()\[\]{}\"'“”«»…*•|<>/\\=~\-–—‐‑\u00ad]+(?:![^\W\d_]+)*")
SIGN_IN_WORD = re.compile(r"[a-zà-ÿ][0-9@!]|[0-9@!][a-zà-ÿ]{2}")
SIGN_IN_CODE = re.compile(r"[A-Z].*[A-Z]|\d{2}|\d[A-Z]|@\.")
LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
NUMBER = re.compile(r"(?:page|pg\.?|p\.|sheet|seite|hoja|blatt|s\.)?\s*[-~\[(]?\s*(\d+|[ivxlc]+)\s*[-~\])]?\s*(?:(?:of|/|von|de|sur)\s*\d+)?", re.I)
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


class Reading(NamedTuple):
    """A text as it is read, and how many hyphens were dropped, confusions undone, gaps opened or closed for it."""

    text: str
    breaks: int
    undone: int
    gaps: int


class Decoder:
    """Joint segmentation of de-lined text, given a lexicon of words with their costs.

    The text is one stream of characters, its line ends being spaces. From every place the lexicon, held as a trie, is
    followed along the stream: a character may stand for itself or, by a confusion, for others; a hyphen with its line
    end, or a gap, may lie within a word; a word may end inside a chunk, where a gap is then opened. What is no word may
    be taken as it stands, at a cost that goes by its shape. The cheapest path over all places is the reading.

    A chunk that is a word as it stands costs nothing, so no path crosses between two such chunks: only stretches of
    text around other chunks and hyphens are decoded, each with those neighbours that a word may reach into.
    """

    def __init__(self, counts: dict[str, int]):
        counts = {w: n for w, n in counts.items() if not any(counts.get(v, 0) >= MISREAD_TIMES * n for v in self.undone_once(w))}
        total = max(sum(counts.values()), 1)
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.trie: dict = {}
        for word, cost in self.cost.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = cost
        self.read: dict[str, Reading] = {}
        self.open_ends: dict[str, list[dict]] = {}

    @staticmethod
    def undone_once(word: str) -> set[str]:
        out = set()
        for a, b in CONFUSIONS:
            at = word.find(a)
            while at >= 0:
                out.add(word[:at] + b + word[at + len(a) :])
                at = word.find(a, at + 1)
        return out

    @staticmethod
    def steps(node: dict, text: str, at: int) -> Iterator[tuple[dict, int, int, str]]:
        """(trie node, place behind, confusions, characters meant) of what the text may say next."""
        c = text[at]
        child = node.get(c.lower())
        if child is not None:
            yield child, at + 1, 0, c.lower()
        for seen, meant in MEANT.get(c, ()):
            if text.startswith(seen, at):
                child = node
                for m in meant:
                    child = child.get(m)
                    if child is None:
                        break
                else:
                    yield child, at + len(seen), 1, meant

    def arcs(self, text: str, start: int) -> list[tuple[int, float, Reading]]:
        """(end, cost, reading) of the words that may stand from a place on: the cheapest reading for each end."""
        best: dict[int, tuple[float, Reading]] = {}
        named = text[start].isupper()
        todo = [(start, self.trie, 0.0, "", 0, 0, 0)]
        while todo:
            at, node, cost, said, breaks, undone, gaps = todo.pop()
            if "" in node and (at not in best or cost + node[""] < best[at][0]):
                best[at] = (cost + node[""], Reading(said, breaks, undone, gaps))
            if at == len(text):
                continue
            for child, behind, n, meant in self.steps(node, text, at):
                todo.append((behind, child, cost + n * (CONFUSED_NAME if named and undone else CONFUSED), said + meant, breaks, undone + n, gaps))
            end = LINE_HYPHEN.match(text, at + 1)
            if end:  # two characters that a hyphen parts and that stand for one
                for child, used, n, meant in self.steps(node, text[at] + text[end.end()], 0):
                    if used == 2:
                        todo.append((end.end() + 1, child, cost + HYPHEN + (CONFUSED_NAME if named and undone else CONFUSED), said + meant, breaks + 1, undone + 1, gaps))
            if at > start and node is not self.trie:
                end = LINE_HYPHEN.match(text, at)
                if end:
                    todo.append((end.end(), node, cost + HYPHEN, said, breaks + 1, undone, gaps))
                    if "-" in node:
                        todo.append((end.end(), node["-"], cost + HYPHEN, said + "-", breaks + 1, undone, gaps))
                elif text[at].isspace() and not text[at - 1].isspace():
                    todo.append((at + len(SPACE.match(text, at).group()), node, cost + SPLIT, said, breaks, undone, gaps + 1))
        return [(end, cost, reading) for end, (cost, reading) in best.items()]

    @staticmethod
    def fixed(atom: str) -> bool:
        """Codes, numbers, capitals and the shortest pieces: they stand as they are."""
        signs = sum(c in SYMBOLS for c in atom)
        lower = sum(c.islower() for c in atom)
        if len(atom) <= 2 or not lower or "_" in atom or lower + 1 < signs or (not signs and not atom.isalpha()):
            return True
        return bool(signs and (not SIGN_IN_WORD.search(atom) or SIGN_IN_CODE.search(atom)))

    def standing(self, atom: str, joined: bool) -> list[tuple[float, Reading]]:
        """Readings of a chunk's piece as it stands, and of a name with its signs undone. joined: it is part of a word broken at a line's end."""
        if atom.lower() in self.cost:
            return [(self.cost[atom.lower()] if joined else 0.0, Reading(atom, 0, 0, 0))]
        if self.fixed(atom):
            part = joined and atom.isalpha() and any(map(str.islower, atom))
            return [(UNKNOWN + UNKNOWN_CHARACTER * len(atom) if part else 0.0, Reading(atom, 0, 0, 0))]
        signs = sum(c in SYMBOLS for c in atom)
        named = NAME + NAME_CHARACTER * len(atom)
        if not signs:
            return [(named if atom[0].isupper() else UNKNOWN + UNKNOWN_CHARACTER * len(atom), Reading(atom, 0, 0, 0))]
        out = [(UNKNOWN + UNKNOWN_CHARACTER * len(atom), Reading(atom, 0, 0, 0))]
        plain = atom
        for a, b in CONFUSIONS:
            if a in SYMBOLS:
                plain = plain.replace(a, b)
        if atom[0].isupper() and len(plain) >= 4 and plain.isalpha():
            out.append((named + CONFUSED * signs, Reading(plain, 0, signs, 0)))
        return out

    @staticmethod
    def case(word: str, seen: str) -> str:
        return word.upper() if seen.isupper() and len(seen) > 1 else word[:1].upper() + word[1:] if seen[:1].isupper() else word

    def decode(self, text: str) -> Reading:
        """The cheapest reading of a stretch of text: Viterbi over its places."""
        got = self.read.get(text)
        if got is not None:
            return got
        spans = {m.start(): m.end() for m in ATOM.finditer(text)}
        inner = {at for a, b in spans.items() for at in range(a, b)}
        behind_hyphen = {m.end() for m in LINE_HYPHEN.finditer(text) if m.start() and text[m.start() - 1].isalnum()}
        best: list[tuple[float, int, Reading] | None] = [None] * (len(text) + 1)
        best[0] = (0.0, 0, Reading("", 0, 0, 0))

        def offer(at: int, end: int, cost: float, reading: Reading) -> None:
            if best[end] is None or best[at][0] + cost < best[end][0] - 1e-9:
                best[end] = (best[at][0] + cost, at, reading)

        for at in range(len(text)):
            if best[at] is None:
                continue
            if at not in inner:
                offer(at, at + 1, 0.0, Reading(text[at], 0, 0, 0))
                continue
            whole = spans.get(at)
            if whole is not None:
                hyphen = LINE_HYPHEN.match(text, whole)
                before = at in behind_hyphen
                for cost, reading in self.standing(text[at:whole], bool(hyphen) or before):
                    offer(at, whole, cost + (KEPT if before else 0.0), reading)
                word, breaks = text[at:whole], 0
                while hyphen and hyphen.end() in spans and text[whole - 1].isalpha() and text[hyphen.end()].isalpha() and len(word) <= LONGEST_WORD:
                    whole = spans[hyphen.end()]
                    word, breaks = word + text[hyphen.end() : whole], breaks + 1
                    for cost, (said, _, undone, _) in self.standing(word, True):
                        offer(at, whole, cost + HYPHEN * breaks, Reading(said, breaks, undone, 0))
                    hyphen = LINE_HYPHEN.match(text, whole)
                if self.fixed(text[at : spans[at]]) and not LINE_HYPHEN.match(text, spans[at]) and spans[at] - at > 2:
                    continue
            opened = 0.0 if whole is not None else SPLIT
            for end, cost, reading in self.arcs(text, at):
                inside = end in inner and end not in spans
                if (inside or opened) and len(reading.text) <= 2:
                    continue
                said = self.case(reading.text, text[at:end])
                offer(at, end, cost + opened, Reading((" " if opened else "") + said, reading.breaks, reading.undone, reading.gaps + bool(opened)))
        parts, end = deque(), len(text)
        while end:
            _, at, reading = best[end]
            parts.appendleft(reading)
            end = at
        got = Reading("".join(p.text for p in parts), sum(p.breaks for p in parts), sum(p.undone for p in parts), sum(p.gaps for p in parts))
        if len(text) <= REMEMBERED:
            if len(self.read) > 400_000:
                self.read.clear()
            self.read[text] = got
        return got

    def reaches(self, left: str, right: str) -> bool:
        """Whether a word may begin in one chunk and end in the next, over the gap between them."""
        if not left[-1].isalnum() or not right[0].isalnum():
            return False
        nodes = self.open_ends.get(left)
        if nodes is None:
            nodes, starts, seen = [], [m.start() for m in ATOM.finditer(left)][-1:], set()
            while starts:
                start = starts.pop()
                todo = [(start, self.trie)]
                seen.add(start)
                while todo:
                    at, node = todo.pop()
                    if at == len(left):
                        nodes.append(node)
                        continue
                    if "" in node and at - start > 2 and at not in seen:
                        starts.append(at)
                    todo += [(behind, child) for child, behind, _, _ in self.steps(node, left, at)]
            if len(left) <= REMEMBERED:
                if len(self.open_ends) > 400_000:
                    self.open_ends.clear()
                self.open_ends[left] = nodes
        todo = [(0, node) for node in nodes]
        while todo:
            at, node = todo.pop()
            if at and "" in node:
                return True
            if at < len(right):
                todo += [(behind, child) for child, behind, _, _ in self.steps(node, right, at)]
        return False

    def repair(self, text: str) -> Reading:
        """The whole text with its words repaired. Line ends stay but for those within words."""
        chunks = [(m.start(), m.end()) for m in CHUNK.finditer(text)]
        known = []
        for a, b in chunks:
            core = text[a:b].strip(EDGES)
            known.append(not core or core.lower() in self.cost or core.isdigit() or (not any(map(str.islower, core)) and core[-1] not in HYPHENS))
        tied = [False] * len(chunks)  # to the chunk before, by a hyphen at a line's end
        if "\n" in text:
            for i in range(1, len(chunks)):
                if text[chunks[i - 1][1] - 1] in HYPHENS and LINE_HYPHEN.match(text, chunks[i - 1][1] - 1) and chunks[i - 1][1] - chunks[i - 1][0] > 1 and text[chunks[i - 1][1] - 2].isalnum():
                    tied[i] = True
                    known[i - 1] = known[i] = False
        for i in range(1, len(chunks)):
            if known[i - 1] and known[i] or tied[i]:
                continue
            tied[i] = self.reaches(text[slice(*chunks[i - 1])], text[slice(*chunks[i])])
        out, last, breaks, undone, gaps = [], 0, 0, 0, 0
        i = 0
        while i < len(chunks):
            j = i + 1
            while j < len(chunks) and tied[j]:
                j += 1
            if j > i + 1 or not known[i]:
                a, b = chunks[i][0], chunks[j - 1][1]
                got = self.decode(text[a:b])
                breaks, undone, gaps = breaks + got.breaks, undone + got.undone, gaps + got.gaps
                if got.text != text[a:b]:
                    out += [text[last:a], got.text]
                    last = b
            i = j
        return Reading("".join(out) + text[last:], breaks, undone, gaps)


def skeleton(text: str) -> str:
    """A form that is alike for a text and for what recognition may take it for."""
    text = text.lower()
    for a, b in (("@", "a"), ("0", "o"), ("!", "i"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("u", "ii"), ("w", "vv"), ("m", "rn"), ("ri", "n"), ("li", "h"), ("d", "cl"), ("c", "e"), ("f", "t")):
        text = text.replace(a, b)
    return re.sub(r"[^a-zà-ÿ]", "", text)


def roman(text: str) -> int | None:
    values = [ROMAN[c] for c in text.lower()]
    return sum(-v if i + 1 < len(values) and values[i + 1] > v else v for i, v in enumerate(values))


def page_number_in(text: str) -> int | None:
    """The number that a text of nothing but a page number gives."""
    text = text.strip()
    if not text or len(text) > 64:
        return None
    plain = re.sub(r"(?<=[A-Za-z])[9@](?=[A-Za-z])", lambda m: {"9": "g", "@": "a"}[m.group()], text)
    m = NUMBER.fullmatch(plain)
    if not m:
        return None
    return int(m.group(1)) if m.group(1).isdigit() else roman(m.group(1))


def header_form(text: str) -> str:
    """A header without the section number before it and the page number behind it, as a skeleton."""
    text = re.sub(r"^\s*[\d.]+\s*[|:·–-]?\s+", "", text)
    return skeleton(re.sub(r"\s+[-|·]?\s*\d+\s*$", "", text))


def stem_title(name: str | None) -> str:
    stem = re.sub(r"\.pdf$", "", (name or "").rsplit("/", 1)[-1], flags=re.I)
    return skeleton(re.sub(r"[_ -](?:v\d+|rev[_ -]?\w|\d+)(?=[_ -]|$)", "", re.sub(r"_(?:v\d+|rev-\w|\d{4})(?=_|$)", "", stem)))


def kinds_of(record: list[tuple[int, str | None, str]], name: str | None) -> list[str]:
    """'header', 'number' or '' for each element (page number, label, text) of a record.

    A header repeats the record's title, which stands once as the title: where no element has the label `title`, the
    first that does so on the first page is taken for it.
    """
    titles = {header_form(t) for _, label, t in record if label == "title"}
    labelled = bool(titles)
    titles = {t for t in titles | {stem_title(name)} if len(t) >= 6}
    kinds, first = [], True
    for page, label, text in record:
        kind = ""
        if label not in SKIPPED_LABELS:
            if page is not None and page_number_in(text) == page:
                kind = "number"
            elif label != "title" and titles and "\n" not in text.strip() and header_form(text) in titles:
                kind = "header" if labelled or not first else ""
                first = False
        kinds.append(kind)
    return kinds


def lexicon(records: DataFrame) -> dict[str, int]:
    """Words of the corpus's texts (not of code, tables and figures) with their counts, summed per batch before they are shuffled.

    At most 1 / LEXICON_SHARE words can make up that share each, so the result is bounded whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, page, _ = child_index(column(batch, "pages"))
            _, element, _ = child_index(field(page, "elements", pa.list_(pa.struct([("label", pa.string())]))))
            label = field(element, "label", pa.string())
            kept = pc.fill_null(pc.invert(pc.is_in(label, pa.array(sorted(SKIPPED_LABELS)))), True)
            words: Counter[str] = Counter()
            for text in field(element, "text", pa.string()).filter(kept).to_pylist():
                if text:
                    words.update(LETTERS.findall(text.lower()))
            yield pa.record_batch({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    counts = records.select("pages").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(LEXICON_COUNT), F.ceil(F.lit(LEXICON_SHARE) * F.col("total")))
    return {r["word"]: r["n"] for r in counts.join(F.broadcast(total)).where(F.col("n") >= least).select("word", "n").collect()}  # total: one row


def paragraphs(lines: list[str], starts: list[int]) -> list[str]:
    """Lines joined into paragraphs: boundaries of least cost, by dynamic programming. starts: 1 where a new element begins, 2 where it or the one before is no running text."""
    n = len(lines)
    if not n:
        return []
    width = max(map(len, lines))

    def between(i: int) -> tuple[float, float]:
        """Costs of joining line i to the one before, and of a boundary there."""
        a, b = lines[i - 1].rstrip(), lines[i].lstrip()
        ended = a[-1:] in ".!?:…\"”»)" or not a
        join = 4.0 * ended * (1.5 if starts[i] else 0.4) + 3.0 * (b[:1].isupper() and starts[i]) + 6.0 * bool(re.match(r"[-*•#|]|\d+[.)] ", b)) + 1.5 * (len(a) < 0.5 * width and ended) + 50.0 * (starts[i] == 2)
        stop = (3.5 if b[:1].islower() else 2.0) * (not ended) + 3.0 * b[:1].islower() + 2.0 * (not starts[i])
        return join, stop

    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        inside = 0.0
        for i in range(j - 1, -1, -1):
            cost = best[i] + (between(i)[1] if i else 0.0) + inside
            if cost < best[j]:
                best[j], back[j] = cost, i
            if i:
                inside += between(i)[0]
            if inside > best[j] + 40:
                break
    out, j = [], n
    while j:
        out.append(" ".join(x.strip() for x in lines[back[j] : j] if x.strip()))
        j = back[j]
    return [p for p in reversed(out) if p]


FOUND = "rec_id bigint, page_number int, elem_no int, kind string, breaks int, confusions int, gaps int, text string"
PARAGRAPHS = "rec_id bigint, page_number int, para_no int, text string"


def repaired(records: DataFrame, part: str) -> DataFrame:
    """`elements`: each repaired element with what was repaired (breaks: hyphens dropped; confusions undone; gaps opened or closed); `paragraphs`: each page's continuous paragraphs.

    records: rec_id, source_file, pages (label, text, reading_order of elements). Null pages, elements and texts give
    nothing; rows delivered twice (equal rec_id) count once; code, tables and figures are left alone and out of the paragraphs.
    """
    words = records.sparkSession.sparkContext.broadcast(lexicon(records))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(words.value)
        for batch in batches:
            record_of, page, _ = child_index(column(batch, "pages"))
            page_of, element, ordinal = child_index(field(page, "elements", pa.list_(pa.struct([("label", pa.string())]))))
            number = field(page, "page_number", pa.int32()).take(pa.array(page_of)).to_pylist()
            label, text = field(element, "label", pa.string()).to_pylist(), field(element, "text", pa.string()).to_pylist()
            order = field(element, "reading_order", pa.int32()).to_pylist()
            owner = record_of[page_of]
            names, ids = batch.column("source_file").to_pylist(), batch.column("rec_id").to_pylist()
            bounds = np.flatnonzero(np.diff(np.concatenate(([-1], owner, [-1])))) if len(owner) else []
            rows, pages = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = range(a, b)
                kinds = kinds_of([(number[i], label[i], text[i] or "") for i in own], names[owner[a]])
                flow: dict[int | None, list[tuple[int, int, str]]] = {}
                for i, kind in zip(own, kinds):
                    if not text[i] or label[i] in SKIPPED_LABELS:
                        continue
                    fixed, breaks, undone, gaps = decoder.repair(text[i])
                    if kind or breaks or undone or gaps:
                        rows.append((ids[owner[a]], number[i], int(ordinal[i]), kind or "text", breaks, undone, gaps, None if kind else fixed))
                    if part == "paragraphs" and not kind:
                        flow.setdefault(number[i], []).append((order[i] if order[i] is not None else int(ordinal[i]) - 1, i, fixed, label[i] in RUNNING))
                for page_no, items in flow.items():
                    lines, starts, before = [], [], True
                    for _, _, fixed, running in sorted(items):
                        own_lines = fixed.replace("\r\n", "\n").split("\n")
                        lines += own_lines
                        starts += [1 if running and before else 2] + [0] * (len(own_lines) - 1)
                        before = running
                    pages += [(ids[owner[a]], page_no, k + 1, p) for k, p in enumerate(paragraphs(lines, starts))]
            cols, schema = (list(zip(*pages)) or [()] * 4, PARAGRAPHS) if part == "paragraphs" else (list(zip(*rows)) or [()] * 8, FOUND)
            kinds_by = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.record_batch({c.split()[0]: pa.array(v, kinds_by[c.split()[1]]) for c, v in zip(schema.split(", "), cols)})

    keys = ["rec_id", "page_number", "para_no" if part == "paragraphs" else "elem_no"]
    return records.select("rec_id", "source_file", "pages").mapInArrow(run, PARAGRAPHS if part == "paragraphs" else FOUND).dropDuplicates(keys)
