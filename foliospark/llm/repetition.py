"""Repetition inside one text: a linear-chain conditional random field over its segments, decoded by Viterbi.

A text is a sequence of segments (lines, sentences within lines, pieces of long sentences). Observed of a segment are its length, its place,
its numbers, whether it and its neighbour were said before as they stand, and how much of it stands in a stretch of
`STRETCH` words said before. The field labels each segment as content or as repetition; the share of words in content
decides whether a text is retained. It was fitted on texts of the tables into which repetition was planted in known
places: the places are the labels, no observation is. Beside it stands the exact share of repeated words of every text.

All steps work on whole batches: words are numbered once for the batch, stretches are compared as rolling hashes that
include the text's number, and Viterbi runs over all texts of the batch at each position.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 5
MIN_SHARE = 0.3
#: A text is retained if at least this share of its words is labelled as content.
RETAINED_SHARE = 0.9
#: A segment is a line or sentence, or so many words of a longer one.
SEGMENT_WORDS = 12
#: Texts are worked on in groups of at most so many characters.
GROUP_CHARS = 4_000_000
#: In fitting: texts with less repetition of their own than this take part, and so many segments of each at most.
PLAIN_SHARE = 0.02
FITTED_SEGMENTS = 150

#: Observations of a segment.
FEATURES = ["one", "share said before", "any said before", "whole segment said before", "so with the one before it", "shorter than STRETCH", "log of length", "place in the text", "share of numbers"]
#: Fitted by fit(*planted(texts)) on the first 200 texts of each table at scale 0.01: emission weights for label 1 less label 0, and transitions.
EMISSION = np.array([-1.426, 2.773, 2.661, 3.756, 0.923, 0.088, -0.533, -0.681, -0.121])
TRANSITION = np.array([[1.586, -0.578], [-0.686, -0.322]])

TOKEN = re.compile(r"\w+|[\n.!?]")


class Segments:
    """Words and segments of a group of texts, numbered through."""

    def __init__(self, texts: list[str]):
        tokens: list[str] = []
        n_tokens = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = TOKEN.findall(text.lower())
            n_tokens[i] = len(own)
            tokens += own
        codes, names = pd.factorize(np.array(tokens, dtype=object)) if tokens else (np.zeros(0, np.int64), np.array([], object))
        stop = np.array([x in ("\n", ".", "!", "?") for x in names], bool)
        is_stop = stop[codes] if len(codes) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(texts)), n_tokens)
        # a new segment starts after each run of stops and with each text
        ends = np.cumsum(is_stop)
        word = ~is_stop
        self.n_texts = len(texts)
        self.doc = doc[word]
        self.code = codes[word].astype(np.uint64)
        after = ends[word]
        new = np.ones(len(after), bool)
        new[1:] = (after[1:] != after[:-1]) | (self.doc[1:] != self.doc[:-1])
        start = np.flatnonzero(new)
        new |= (np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))) % SEGMENT_WORDS == 0
        self.segment = np.cumsum(new) - 1
        self.segment_doc = self.doc[new]
        self.words = np.bincount(self.doc, minlength=len(texts))
        self.repeated = self._repeated()
        self.numeric = np.array([str(x).isdigit() for x in names], bool)[codes[word]] if len(codes) else np.zeros(0, bool)

    def _repeated(self) -> np.ndarray:
        """Words that stand in a stretch that was already said earlier in the same text."""
        n = len(self.code)
        marks = np.zeros(n + 1, np.int64)
        if n >= STRETCH:
            h = np.zeros(n - STRETCH + 1, np.uint64)
            for k in range(STRETCH):
                h = h * np.uint64(0x9E3779B97F4A7C15) + (self.code[k : n - STRETCH + 1 + k] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            inside = self.doc[: n - STRETCH + 1] == self.doc[STRETCH - 1 :]
            h ^= self.doc[: n - STRETCH + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            order = np.argsort(h, kind="stable")
            again = np.zeros(len(h), bool)
            again[order[1:]] = h[order[1:]] == h[order[:-1]]
            at = np.flatnonzero(again & inside)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + STRETCH, -1)
        return np.cumsum(marks[:-1]) > 0

    def share(self) -> np.ndarray:
        """Exact share of repeated words of each text; 0 for a text without words."""
        return np.bincount(self.doc, self.repeated, self.n_texts) / np.maximum(self.words, 1)

    def _said(self, h: np.ndarray) -> np.ndarray:
        """Which segments have a hash that an earlier one of the same text has."""
        h = h ^ (self.segment_doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(h, kind="stable")
        said = np.zeros(len(h), bool)
        said[order[1:]] = h[order[1:]] == h[order[:-1]]
        return said

    def observations(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of each segment, and its number of words."""
        n = len(self.segment_doc)
        size = np.bincount(self.segment, minlength=n)
        some = np.maximum(size, 1)
        share = np.bincount(self.segment, self.repeated, n) / some
        start = np.cumsum(size) - size
        place = np.arange(len(self.code)) - start[self.segment] if n else np.zeros(0, np.int64)
        mixed = (self.code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        own = np.add.reduceat(mixed, start) if n else np.zeros(0, np.uint64)
        both = own.copy()
        both[1:] += own[:-1] * np.uint64(0x94D049BB133111EB)
        count = np.bincount(self.segment_doc, minlength=self.n_texts)
        at = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        along = at / np.maximum(np.repeat(count, count) - 1, 1)
        numbers = np.bincount(self.segment, self.numeric, n) / some
        return np.stack([np.ones(n), share, share > 0, self._said(own), self._said(both) & (at > 0), size < STRETCH, np.log1p(size) / 4, along, numbers], 1).astype(float), size

    def grid(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values by text and position (0 beyond a text's end), and the texts and positions of the segments."""
        count = np.bincount(self.segment_doc, minlength=self.n_texts)
        position = np.arange(len(self.segment_doc)) - np.repeat(np.cumsum(count) - count, count)
        table = np.zeros((self.n_texts, int(count.max()) if len(count) else 0))
        table[self.segment_doc, position] = values
        return table, self.segment_doc, position


def viterbi(score: np.ndarray, length: np.ndarray, transition: np.ndarray = TRANSITION) -> np.ndarray:
    """Best labels (0 or 1) of many sequences at once. score: by text and position, of label 1 less label 0."""
    n, steps = score.shape
    best = np.zeros((n, 2))
    back = np.zeros((steps, n, 2), np.int8)
    if steps:
        best[:, 1] = score[:, 0]
    for t in range(1, steps):
        live = t < length
        to = best[:, :, None] + transition[None]
        back[t] = to.argmax(1)
        new = to.max(1)
        new[:, 1] += score[:, t]
        best[live] = new[live]
    labels = np.zeros((n, steps), np.int8)
    now = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        inside = t < length
        labels[inside, t] = now[inside]
        if t:
            prior = back[t, np.arange(n), now]
            now = np.where(inside, prior, now)
    return labels


def measure(texts: list[str], emission: np.ndarray = EMISSION, transition: np.ndarray = TRANSITION) -> tuple[np.ndarray, np.ndarray]:
    """(share of words labelled as content, 1 for a text without words; exact share of repeated words)."""
    labelled, exact = np.zeros(len(texts)), np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        stop, total = start, 0
        while stop < len(order) and (stop == start or total + sizes[order[stop]] <= GROUP_CHARS):
            total += sizes[order[stop]]
            stop += 1
        group = order[start:stop]
        s = Segments([texts[i] for i in group])
        x, size = s.observations()
        table, doc, position = s.grid(x @ emission)
        labels = viterbi(table, np.bincount(s.segment_doc, minlength=len(group)), transition)
        said = np.bincount(doc, labels[doc, position] * size, len(group)) / np.maximum(s.words, 1)
        labelled[group] = 1 - said
        exact[group] = s.share()
        start = stop
    return labelled, exact


def planted(texts: list[str], seed: int = 11) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts with repetition planted into every other one, and the spans (of characters) of what was planted.

    A block of one to four lines is said again, up to thirty times, in one place or scattered; some copies differ in a word.
    """
    rng = random.Random(seed)
    plain = [t for t, share in zip(texts, Segments(texts).share()) if share < PLAIN_SHARE]
    out, spans = [], []
    for i, text in enumerate(plain):
        lines = text.split("\n")
        said = [k for k, x in enumerate(lines) if len(x.split()) >= 4]
        pieces = [(x, False) for x in lines]
        if i % 2 == 0 and said:
            a = rng.choice(said)
            block = lines[a : a + rng.randint(1, 4)]
            if i % 8 == 4:  # a few words said over and over within one line
                phrase = " ".join(block[0].split()[: rng.randint(2, 8)]) + " "
                block = [phrase * rng.randint(3, 40)]
            once = rng.randint(a + len(block), len(lines))
            for _ in range(rng.randint(1, 30)):
                at = once if i % 4 == 0 else rng.randint(a + len(block), len(pieces))
                copy = [re.sub(r"\w+$", str(rng.randint(2, 999)), x) if rng.random() < 0.1 else x for x in block]
                pieces[at:at] = [(x, bool(x.strip())) for x in copy]
        own, at = [], 0
        for x, is_copy in pieces:
            if is_copy:
                own.append((at, at + len(x)))
            at += len(x) + 1
        out.append("\n".join(x for x, _ in pieces))
        spans.append(own)
    return out, spans


def labels(s: Segments, texts: list[str], spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """1 for the segments of which at least half the words stand in a span."""
    inside = []
    for text, own in zip(texts, spans):
        at = 0
        for m in re.finditer(r"\w+", text.lower()):
            while at < len(own) and own[at][1] <= m.start():
                at += 1
            inside.append(at < len(own) and own[at][0] <= m.start())
    size = np.bincount(s.segment, minlength=len(s.segment_doc))
    return (np.bincount(s.segment, inside, len(s.segment_doc)) * 2 >= size).astype(float)


def fit(texts: list[str], spans: list[list[tuple[int, int]]], steps: int = 600, rate: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the field by gradient ascent of the likelihood of the labels that the planted spans give, on a bounded list of texts."""
    few = [len(re.findall(r"[\n.!?]", t)) <= FITTED_SEGMENTS for t in texts]
    texts, spans = [t for t, k in zip(texts, few) if k], [x for x, k in zip(spans, few) if k]
    s = Segments(texts)
    x, _ = s.observations()
    gold = labels(s, texts, spans)
    count = np.bincount(s.segment_doc, minlength=len(texts))
    y, doc, position = s.grid(gold)
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    n = max(len(gold), 1)
    y = y.astype(int)
    for _ in range(steps):
        score = s.grid(x @ w)[0]
        live = np.arange(score.shape[1])[None] < count[:, None]
        emit = np.stack([np.zeros_like(score), score], 2)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for k in range(1, score.shape[1]):
            alpha[:, k] = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t[None], axis=1) + emit[:, k]
        for k in range(score.shape[1] - 2, -1, -1):
            step = np.logaddexp.reduce(t[None] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(live[:, k + 1, None], step, 0)
        z = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        w += rate * ((gold - one[doc, position]) @ x / n - 1e-4 * w)
        for a in range(2):
            for b in range(2):
                pair = np.exp(alpha[:, :-1, a] + t[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * live[:, 1:]
                seen = ((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum()
                t[a, b] += rate * ((seen - pair.sum()) / n - 1e-4 * t[a, b])
    return w, t


def record_texts(records: DataFrame) -> DataFrame:
    """(rec_id, text): all element texts of a record, pages by number, elements as written, joined by line feeds."""
    pages = F.array_sort(F.transform(F.filter("pages", lambda p: p.isNotNull()), lambda p: F.struct(p["page_number"].alias("n"), F.transform(F.filter(p["elements"], lambda e: e.isNotNull()), lambda e: e["text"]).alias("texts"))))
    return records.select("rec_id", F.array_join(F.flatten(F.transform(F.filter(pages, lambda p: p["texts"].isNotNull()), lambda p: p["texts"])), "\n").alias("text"))


def repetition(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, `content_share` (of words, by the field), `retained` (whether that is enough) and the exact `repeated_share` of each text.

    A null, empty or blank text has content share 1, is retained and repeats nothing. Repeated rows each give a row. Words are
    runs of letters, digits and underscores, case aside. There is no shuffle; a very long text is a group of its own.
    """
    schema = texts.select(*keys).schema.add("content_share", "double").add("retained", "boolean").add("repeated_share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, exact = measure([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch({**{k: batch.column(k) for k in keys}, "content_share": pa.array(content), "retained": pa.array(content >= RETAINED_SHARE), "repeated_share": pa.array(exact)})

    return texts.select(*keys, "text").mapInArrow(run, schema)
