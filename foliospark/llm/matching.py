"""Matching two tables that share no key: BM25 over all attributes, exact pruning, mutual nearest, calibrated confidence.

Both sides become bags of terms from their attributes: neighbouring word pairs of the code and of the text around it, the
words of the file name, the page. Blocks of documents are indexed in memory, and the queries pass by them. A term's largest
possible contribution bounds what it can add, so a query looks up only its essential terms: with the rest alone a document
can't reach the floor, a share of what the query's own terms add up to, below which nothing is a match, nor the bar, the
second best score found or 1 - MARGIN of the best, whichever is less. Common terms are seldom essential, but count in the bound and in the full scores by which the
documents found are ranked. All documents above the bar are compared, of equal texts the best.
For these the order-keeping overlap of both texts is measured, and the score, its gap to the runner-up, whether the pair is
mutually nearest, the names, pages, contexts, boxes and scores give a confidence through a logistic function. Its weights
were fitted on planted pairs: pieces of code of the table damaged in known ways, and other pieces made to look like them.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.lookalike import unify
from foliospark.runtime import materialize

K1, B = 1.2, 0.5
#: A match has at least this share of the score that all terms of the query could give.
FLOOR_SHARE = 0.08
#: ... and at least this many times the weight of a term that occurs in one document only.
FLOOR_TERMS = 1.0
#: ... but never more than this share of what those of its terms add up to that occur in documents at all.
FLOOR_KNOWN = 0.5
#: Documents indexed by one task (some 60 terms of 24 bytes each), queries that pass by one task's index, and the least number
#: of tasks: an index is built once for each part of the queries.
BLOCK_DOCUMENTS = 250_000
PART_QUERIES = 200_000
#: Texts with more documents together than this get the documents' scores by a pass over the attributes' postings, not from each document's own.
OWN_DOCUMENTS = 2_000
LEAST_TASKS = 6
#: Postings that a query looks up before it takes its bar from what it found.
LOOKED_UP = 1024
#: Postings that are looked up beyond that, before documents are scored one by one.
FURTHER = 4_000
#: Documents that are scored in full first, to raise the bar.
LIKELIEST = 16
#: What an occurrence in the context counts, beside one in the code (BM25F).
CONTEXT_WEIGHT = 0.2
#: Documents are compared whose score is at least 1 - MARGIN of the query's best, and the two best.
MARGIN = 0.1
#: Pairs with less overlap than this aren't compared any further.
FAR = 0.6
#: A pair is a match from this confidence on.
MIN_CONFIDENCE = 0.5

#: Columns that each side has beside its key; any of them may be null.
ATTRIBUTES = {"text": "string", "name": "string", "page": "int", "context": "string", "box": "array<double>", "score": "double"}
#: Weights of FEATURES, fitted by fit() on the 4,000 pairs retrieved at the 0.1 scale for planted() queries of even number; the README has the reliability of the others.
FEATURES = ["one", "overlap", "gap", "mutual", "name", "page", "context", "box", "score"]
WEIGHTS = np.array([-37.809, 42.695, 1.131, 0.579, 0.696, 0.019, -1.438, 1.622, 0.364])

NUMBERED = re.compile(r"^\s*\d+ {2,}")
CODE_SIGNS = re.compile(r"[_={}<>\[\]\\#%]|\);")
TOKENS = re.compile(r"[^\W\d_]+|\d+")


def is_prose(line: str) -> bool:
    """Page text around a piece of code: several plain words, begun like a sentence, without signs of code."""
    words = re.findall(r"[^\W\d_]{2,}", line)
    return len(words) >= 5 and line[:1].isupper() | line[:1].isdigit() and not CODE_SIGNS.search(line) and sum(w.islower() for w in words) >= 0.6 * len(words)


def code_lines(text: str) -> list[str]:
    """Lines of a text in their consistent form, without line numbers and surrounding page text."""
    lines = [NUMBERED.sub("", line) for line in text.split("\n")]
    kept = [line for line in lines if line.strip() and not is_prose(line.strip())]
    return kept or [line for line in lines if line.strip()]


def squeezed(lines: list[str]) -> str:
    return re.sub(r"[\W_]+", "", "\n".join(lines).lower())


def name_words(name: str | None) -> list[str]:
    stem = re.sub(r"\.pdf$", "", (name or "").rsplit("/", 1)[-1], flags=re.I)
    return TOKENS.findall(stem.lower())


def code_terms(text: str) -> Counter:
    """Terms of the code with their frequencies; text in its consistent form."""
    out: Counter[str] = Counter()
    for line in code_lines(text):
        words = TOKENS.findall(line.lower())
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    return out


def attribute_terms(name: str | None, page: int | None, context: str | None) -> Counter:
    """Terms of the other attributes; context in its consistent form."""
    out: Counter[str] = Counter()
    words = TOKENS.findall(context.lower()) if context else []
    for a, b in zip(words, words[1:]):
        out[f"c:{a} {b}"] += CONTEXT_WEIGHT
    words = name_words(name)
    out.update(f"f:{a} {b}" for a, b in zip(words, words[1:]))
    out.update(f"f:{a}" for a in words[:1])
    if words and page is not None:
        out[f"p:{words[0]} {page}"] += 1
    return out


def overlap(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for m in map(where.get, b):
        if m:  # what is carried beyond the last bit never comes back
            u = v & m
            v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


def name_likeness(a: str | None, b: str | None) -> float:
    """Share of the shorter name's letters kept in order in the other; a null name says nothing (0.5)."""
    x, y = "".join(name_words(a)), "".join(name_words(b))
    if not x or not y:
        return 0.5
    x, y = sorted((x, y), key=len)
    return overlap(x, y) / len(x)


def text_likeness(a: str | None, b: str | None) -> float:
    """Share of the shorter text's letters and digits kept in order in the other; a null or empty text says nothing (0.5)."""
    x, y = squeezed([a or ""]), squeezed([b or ""])
    if not x or not y:
        return 0.5
    x, y = sorted((x, y), key=len)
    return overlap(x, y) / len(x)


def box_likeness(a: list[float] | None, b: list[float] | None) -> float:
    """1 for boxes that are equal but for their unit and the order of their corners, falling to 0; no box, a short or a flat one says nothing (0.5)."""
    if a is None or b is None or min(len(a), len(b)) < 4 or any(v is None or v != v for v in [*a[:4], *b[:4]]):
        return 0.5
    x, y = ([min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])] for v in (a, b))
    if x[2] <= 0 or y[2] <= 0 or x[3] <= 0 or y[3] <= 0:
        return 0.5
    unit = max(x[2:]) / max(y[2:])
    return max(0.0, 1 - 10 * max(abs(u - unit * v) for u, v in zip(x, y)) / max(x[2:]))


def score_given(score: float | None) -> float:
    """A score between 0 and 1; percentages are brought to that scale, nothing is 0.5."""
    return 0.5 if score is None or score != score else min(max(score / 100 if score > 1 else score, 0.0), 1.0)


def hashed(bag: Counter) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t in bag]


def term_bags(rows: DataFrame, key: str) -> DataFrame:
    """(key, class, t, tf, len, at, atf): hashed terms of the code and of the other attributes of each row with columns key, text, name, page, context, with their frequencies.

    class: hash of the text in its consistent form; len: number of the code's terms. Blank texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in (key, "text", "name", "page", "context")))
            kept = [r for r in given if r[1] and not r[1].isspace()]
            texts, contexts = unify([r[1] for r in kept]), unify([r[4] or "" for r in kept])
            code = [code_terms(t) for t in texts]
            others = [attribute_terms(r[2], r[3], c) for r, c in zip(kept, contexts)]
            longs, floats = pa.list_(pa.int64()), pa.list_(pa.float32())
            yield pa.record_batch({
                key: pa.array([r[0] for r in kept], pa.string()), "class": pa.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64()),
                "t": pa.array([hashed(x) for x in code], longs), "tf": pa.array([list(x.values()) for x in code], floats), "len": pa.array([sum(x.values()) for x in code], pa.float32()),
                "at": pa.array([hashed(x) for x in others], longs), "atf": pa.array([list(x.values()) for x in others], floats),
            })

    return rows.select(key, "text", "name", "page", "context").mapInArrow(run, f"{key} string, class bigint, t array<bigint>, tf array<float>, len float, at array<bigint>, atf array<float>")


class Postings:
    """An inverted index: the owners of each term, in order, and each owner's terms."""

    def __init__(self, sizes: np.ndarray, t: np.ndarray, saturation: np.ndarray):
        order = np.argsort(t, kind="stable")
        self.own_first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.own_saturation = saturation
        t = t[order]
        starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        self.keys, self.first = t[starts], np.append(starts, len(t))
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.saturation = saturation[order]
        self.own_place = np.empty(len(t), np.int32)
        self.own_place[order] = np.repeat(np.arange(len(self.keys), dtype=np.int32), np.diff(self.first)) if len(t) else 0
        self.weights = np.zeros(len(self.keys))
        self.scores = np.zeros(len(sizes))

    def places(self, t: np.ndarray) -> np.ndarray:
        """The place of each term in the index, -1 for those that no owner here has."""
        if not len(self.keys):
            return np.full(len(t), -1)
        at = np.minimum(np.searchsorted(self.keys, t), len(self.keys) - 1)
        return np.where(self.keys[at] == t, at, -1)

    def look_up(self, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Add the terms' contributions to their owners' scores; the owners, once for each term."""
        if not len(at):
            return np.zeros(0, np.int32)
        start, end = self.first[at], self.first[at + 1]
        spans = list(zip(start.tolist(), end.tolist()))
        owners = np.concatenate([self.owner[a:b] for a, b in spans])
        np.add.at(self.scores, owners, np.repeat(idf, end - start) * np.concatenate([self.saturation[a:b] for a, b in spans]))
        return owners

    def full(self, owners: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Full scores of owners for terms at places with weights, from the owners' own postings."""
        size = self.own_first[owners + 1] - self.own_first[owners]
        score, some = np.zeros(len(owners)), size > 0
        size, begin = size[some], self.own_first[owners[some]]
        if len(size):
            start = np.cumsum(size) - size
            own = np.arange(size.sum()) + np.repeat(begin - start, size)
            self.weights[at] = idf
            score[some] = np.add.reduceat(self.weights[self.own_place[own]] * self.own_saturation[own], start)
            self.weights[at] = 0.0
        return score


class Block:
    """The distinct texts (classes) of some documents and the documents' other attributes, both indexed, and the scores of queries against them.

    A document's score is that of its text and that of its attributes; however many documents have one text, its terms are
    indexed and looked up once, and of its documents the one whose attributes fit best stands for it.
    """

    def __init__(self, code: Postings, attributes: Postings, ids: list[str], of: np.ndarray):
        """ids, of: the documents in order of their class and id, and the class of each; every class has a document."""
        self.code, self.attributes, self.ids, self.of = code, attributes, ids, of
        self.docs_first = np.searchsorted(of, np.arange(len(code.scores) + 1))

    @staticmethod
    def bar(scores: np.ndarray) -> float:
        """What a text must reach to be compared: the second best score, or 1 - MARGIN of the best if that is less."""
        if len(scores) < 2:
            return 0.0
        second, first = np.partition(scores, -2)[-2:]
        return float(min(second, (1 - MARGIN) * first))

    def scored(self, classes: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], more: bool, left: np.ndarray, seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(best document, full score) of each class. terms: places and weights of code and attributes; more: whether some of the code weren't looked up yet; left: which attributes weren't."""
        code = self.code.full(classes, *terms[0]) if more else self.code.scores[classes]
        size = self.docs_first[classes + 1] - self.docs_first[classes]
        start = np.cumsum(size) - size
        docs = np.arange(size.sum()) + np.repeat(self.docs_first[classes] - start, size)
        if left.any() and len(docs) <= OWN_DOCUMENTS:
            other = self.attributes.full(docs, *terms[1])
        else:
            at, idf = terms[1]
            seen.append(self.attributes.look_up(at[left], idf[left]))
            left[:] = False
            other = self.attributes.scores[docs]
        other = np.round(other, 9)
        most = np.maximum.reduceat(other, start)
        firsts = np.flatnonzero(other == np.repeat(most, size))
        of = np.repeat(np.arange(len(classes)), size)[firsts]
        return docs[firsts[np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))]], np.round(code + most, 9)

    def best(self, t: np.ndarray, idf: np.ndarray, most: np.ndarray, code: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, full scores), one for each text that reaches the floor and the bar.

        Terms are looked up from the one that can add most, until the rest of them can't lift another document to the bar.
        """
        at = np.where(code, self.code.places(t), self.attributes.places(t))
        kept = at >= 0
        at, idf, most, code = at[kept], idf[kept], most[kept], code[kept]
        order = np.argsort(-idf * most, kind="stable")
        at, idf, most, code = at[order], idf[order], most[order], code[order]
        rest = np.append(np.cumsum((idf * most)[::-1])[::-1], 0.0) * (1 + 1e-9)
        sizes = np.empty(len(at), np.int64)
        for index, own in ((self.code, code), (self.attributes, ~code)):
            sizes[own] = index.first[at[own] + 1] - index.first[at[own]]
        hits = np.cumsum(sizes)
        texts, docs, bar, k, first, second, looked_up = [], [], floor, 0, -1, 0.0, 0
        while k < len(at) and rest[k] >= bar:
            more = max(k + 1, int(np.searchsorted(hits, 4 * looked_up + LOOKED_UP, "right")))
            more = min(more, int(np.count_nonzero(rest[:-1] >= bar)))
            own = code[k:more]
            texts.append(self.code.look_up(at[k:more][own], idf[k:more][own]))
            docs.append(self.attributes.look_up(at[k:more][~own], idf[k:more][~own]))
            k, looked_up = more, hits[more - 1]
            classes, value = self.partial(texts[-1], docs[-1])
            if len(value):
                top = value.argmax()
                if first < 0 or value[top] >= self.code.scores[first]:
                    first = classes[top]
                second = max(second, value.max(where=classes != first, initial=0.0))
                bar = max(bar, min(second, (1 - MARGIN) * value[top]))
        found, score = np.zeros(0, np.int64), np.zeros(0)
        if texts:
            # some more terms while they are cheap: what is left can then lift few others
            more = max(k, int(np.searchsorted(hits, looked_up + FURTHER, "right")))
            own = code[k:more]
            texts.append(self.code.look_up(at[k:more][own], idf[k:more][own]))
            docs.append(self.attributes.look_up(at[k:more][~own], idf[k:more][~own]))
            k = more
            classes, value = self.partial(np.concatenate(texts), np.concatenate(docs))
            kept = value + rest[k] >= bar - 1e-9
            candidates, inverse = np.unique(classes[kept], return_inverse=True)
            likely = np.zeros(len(candidates))
            np.maximum.at(likely, inverse, value[kept])
            terms = [(at[code], idf[code]), (at[~code], idf[~code])]
            later = np.arange(len(at)) >= k
            more, left = bool(later[code].any()), later[~code]
            if len(candidates) > LIKELIEST:  # full scores of the likeliest raise the bar for the others
                bar = max(bar, self.bar(self.scored(np.sort(candidates[np.argpartition(likely, -LIKELIEST)[-LIKELIEST:]]), terms, more, left, docs)[1]))
                candidates = candidates[likely + rest[k] >= bar - 1e-9]
            if len(candidates):
                found, score = self.scored(candidates, terms, more, left, docs)
                kept = score >= max(floor, self.bar(score)) - 1e-9
                found, score = found[kept], score[kept]
            self.code.scores[np.concatenate(texts)] = 0.0
            self.attributes.scores[np.concatenate(docs)] = 0.0
        return found, score

    def partial(self, texts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes, values): what is known so far of classes that were touched by their text or by a document of theirs."""
        of = self.of[docs]
        return np.concatenate((texts, of)), np.concatenate((self.code.scores[texts], self.code.scores[of] + self.attributes.scores[docs]))


#: Rows that a task gets, in this order.
TEXTS, DOCUMENTS, QUERIES = range(3)


def packed(rows: DataFrame, kind: int) -> DataFrame:
    """(block, kind, pack): rows with a block, packed: an index is read whole by several tasks, so its rows travel in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            for k in np.unique(block):
                part = batch.filter(pa.array(block == k)).drop_columns(["block"])
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "kind": pa.array([kind], pa.int32()), "pack": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    return rows.mapInArrow(run, "block int, kind int, pack binary")


def unpacked(packs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packs]).combine_chunks()


def indexed(packs: dict[int, list[bytes]]) -> Block:
    """A block's index from its packed texts and documents, in order of class and id."""
    texts, docs = (unpacked(packs[k]) for k in (TEXTS, DOCUMENTS))
    texts, docs = texts.sort_by("class"), docs.sort_by([("class", "ascending"), ("d", "ascending")])
    flat = lambda column: pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)
    postings = [Postings(pc.list_value_length(x.column("t")).to_numpy(), flat(x.column("t")), flat(x.column("saturation"))) for x in (texts, docs)]
    return Block(*postings, docs.column("d").to_pylist(), np.searchsorted(texts.column("class").to_numpy(), docs.column("class").to_numpy()))


def block_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, d, score) from rows (task, kind, pack, q, t, idf, most, code, floor) sorted by task and kind: texts and documents are indexed, queries stream by."""
    block, task, packs = None, None, {TEXTS: [], DOCUMENTS: []}
    flat = lambda column: pc.list_flatten(column).to_numpy(zero_copy_only=False)
    for batch in batches:
        runs = pc.add(pc.multiply(batch.column("task"), 3), batch.column("kind")).to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1], [True]))) if len(runs) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows, kind = batch.slice(a, b - a), int(runs[a] % 3)
            if task != runs[a] // 3:
                task, block, packs = runs[a] // 3, None, {TEXTS: [], DOCUMENTS: []}
            if kind != QUERIES:
                packs[kind] += rows.column("pack").to_pylist()
                continue
            if block is None:
                if not packs[TEXTS]:
                    continue
                block, packs = indexed(packs), {TEXTS: [], DOCUMENTS: []}
            t, idf, most, code = (flat(rows.column(c)) for c in ("t", "idf", "most", "code"))
            ends = np.cumsum(pc.list_value_length(rows.column("t")).to_numpy())
            qs, ds, scores = [], [], []
            for q, floor, i, j in zip(rows.column("q").to_pylist(), rows.column("floor").to_pylist(), np.append(0, ends[:-1]), ends):
                docs, score = block.best(t[i:j], idf[i:j], most[i:j], code[i:j], floor)
                qs += [q] * len(docs)
                ds += [block.ids[x] for x in docs]
                scores.append(score)
            yield pa.record_batch({"q": pa.array(qs, pa.string()), "d": pa.array(ds, pa.string()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})


def retrieve(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(q, d, score): for each query the documents of its best scores, of equal texts the best (of equals the first by d).

    queries: q, text, name, page, context; documents: d and the same. The score is BM25 of the code, its terms weighed
    against the distinct texts, and of the other attributes, weighed against the documents. All documents that can reach the
    floor are scored, with all terms however common. Documents are dealt into blocks by their key, so that those of one
    text spread too, and queries into parts: a task indexes a block, and a part passes by.
    """
    bags = materialize(term_bags(documents, "d"))
    texts = materialize(bags.select("class", "t", "tf", "len").dropDuplicates(["class"]))
    n, n_texts, mean = bags.count(), texts.count(), texts.agg(F.avg("len")).first()[0] or 1.0
    if not n:
        return queries.sparkSession.createDataFrame([], "q string, d string, score double")
    saturated = lambda size: lambda tf: (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).cast("float")
    weighed = texts.select("class", "t", F.transform("tf", saturated(F.col("len"))).alias("saturation"))
    documents = bags.select("d", "class", F.col("at").alias("t"), F.transform("atf", saturated(F.lit(mean))).alias("saturation"))
    idf = lambda of: F.log((F.lit(of) + 1.0) / (F.count(F.lit(1)) + 0.5)).alias("idf")
    rarest = float(np.log((n + 1) / 1.5))

    def weights(rows: DataFrame, of: int, code: bool) -> DataFrame:
        postings = rows.select(F.explode(F.arrays_zip("t", "saturation")).alias("x")).select("x.*")
        return postings.groupBy("t").agg(idf(of), F.max("saturation").alias("most")).withColumn("code", F.lit(code))

    weight = weights(weighed, n_texts, True).unionByName(weights(documents, n, False))
    pairs = F.concat(F.arrays_zip("t", "tf"), F.transform(F.arrays_zip("at", "atf"), lambda x: F.struct(x["at"].alias("t"), x["atf"].alias("tf"))))
    asked = term_bags(queries, "q").select("q", F.explode(pairs).alias("x")).select("q", "x.t", F.least("x.tf", F.lit(1.0)).alias("w")).join(weight, "t", "left")
    known = F.array_sort(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("t", "idf", "most", "code"))))
    asked = asked.groupBy("q").agg(F.sum(F.col("w") * F.coalesce("idf", F.lit(rarest))).alias("total"), F.sum(F.col("w") * F.col("idf")).alias("known"), known.alias("bag"))
    # a copy reaches the floor even if all its terms are common
    floor = F.least(F.greatest(FLOOR_SHARE * F.col("total"), F.lit(FLOOR_TERMS * rarest)), FLOOR_KNOWN * F.col("known"))
    asked = asked.where("known > 0").select("q", *[F.col(f"bag.{c}").alias(c) for c in ("t", "idf", "most", "code")], floor.alias("floor"))
    blocks = -(-n // BLOCK_DOCUMENTS)
    parts = max(-(-queries.select("q").count() // PART_QUERIES), -(-LEAST_TASKS // blocks))
    none = lambda kind: F.lit(None).cast(kind)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    there = bags.select("class", place("d", blocks).alias("block")).distinct()
    index = packed(weighed.join(there, "class").select("block", "class", "t", "saturation"), TEXTS).unionByName(packed(documents.select(place("d", blocks).alias("block"), "class", "d", "t", "saturation"), DOCUMENTS))
    asks = {"q": "string", "t": "array<bigint>", "idf": "array<double>", "most": "array<float>", "code": "array<boolean>", "floor": "double"}
    first = index.select("block", each(parts).alias("part"), "kind", "pack", *[none(t).alias(c) for c, t in asks.items()])
    last = asked.select(each(blocks).alias("block"), place("q", parts).alias("part"), F.lit(QUERIES).alias("kind"), none("binary").alias("pack"), *asks)
    dealt = first.unionByName(last).withColumn("task", F.col("block") * parts + F.col("part")).drop("block", "part")
    dealt = dealt.repartitionById(blocks * parts, F.col("task")).sortWithinPartitions("task", "kind")
    full = dealt.mapInArrow(block_scores, "q string, d string, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    ranked = full.withColumns({"rank": F.row_number().over(best), "top": F.first("score").over(best)})
    return ranked.where((F.col("rank") <= 2) | (F.col("score") >= (1 - MARGIN) * F.col("top") - 1e-9)).drop("rank", "top")


def measured_pairs(pairs: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs with the features of each. Names, pages, contexts and boxes of pairs whose overlap is below FAR say nothing (0.5): no confidence near MIN_CONFIDENCE is to be had there."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).withColumn("next", F.coalesce(F.lead("score").over(best), F.lit(0.0)))
    gap = F.when(F.col("rank") == 1, (F.col("score") - F.col("next")) / F.col("score")).otherwise(0.0)
    nearest = pairs.groupBy("d").agg(F.max("score").alias("top"))
    joined = ranked.select("q", "d", "score", gap.alias("gap")).join(nearest, "d").withColumn("mutual", (F.col("score") == F.col("top")).cast("double")).drop("top")
    sides = joined.join(queries.select("q", *[F.col(c).alias(f"q_{c}") for c in ATTRIBUTES]), "q")
    sides = sides.join(documents.select("d", *[F.col(c).alias(f"d_{c}") for c in ATTRIBUTES]), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            known = sorted({*col["q_text"], *col["d_text"]})
            form = {t: squeezed(code_lines(u)) for t, u in zip(known, unify(known))}
            left, right = ([form[t] for t in col[c]] for c in ("q_text", "d_text"))
            same = [overlap(a, b) / len(a) if a else 0.0 for a, b in zip(left, right)]
            pair = lambda of, c: [of(a, b) if o >= FAR else 0.5 for a, b, o in zip(col[f"q_{c}"], col[f"d_{c}"], same)]
            page = pair(lambda a, b: 0.5 if a is None or b is None else float(a == b), "page")
            given = [score_given(v) for v in col["q_score"]]
            x = np.array([np.ones(len(same)), same, col["gap"], col["mutual"], pair(name_likeness, "name"), page, pair(text_likeness, "context"), pair(box_likeness, "box"), given]).T
            confidence = 1 / (1 + np.exp(-(x @ WEIGHTS)))
            yield pa.record_batch({"q": batch.column("q"), "d": batch.column("d"), "score": batch.column("score"), "features": pa.array(x.tolist(), pa.list_(pa.float64())), "confidence": pa.array(confidence)})

    return sides.mapInArrow(run, "q string, d string, score double, features array<double>, confidence double")


def match(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(q, d, score, confidence): each query's document, if one is a match; a document may have several queries.

    queries: q (unique but for repeated rows) and ATTRIBUTES; documents: d and the same. Null or blank texts match
    nothing; other nulls are no evidence either way. Ties go to the smaller d. Extra columns are ignored, and
    empty tables give an empty table.
    """
    queries = queries.select("q", *ATTRIBUTES).dropDuplicates(["q"])
    documents = documents.select("d", *ATTRIBUTES).dropDuplicates(["d"])
    pairs = materialize(retrieve(queries, documents))
    order = Window.partitionBy("q").orderBy(F.desc("confidence"), F.desc("score"), "d")
    best = measured_pairs(pairs, queries, documents).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return best.where(F.col("confidence") >= MIN_CONFIDENCE).select("q", "d", "score", "confidence")


def planted(pieces: list[dict], seed: int = 17) -> list[dict]:
    """Queries made from documents (d and ATTRIBUTES), with `truth`: their d, or None for another piece of code that looks like it.

    A match is the piece damaged in one of six ways (unchanged, misread signs, a part, within page text, cut, without spaces), an
    impostor is the piece with a half to a quarter of its names, and its numbers, changed. Names are respelled, pages shifted, contexts and
    boxes damaged or brought to another unit, or missing, alike for both.
    """
    rng = random.Random(seed)
    names = sorted({w for x in pieces for w in re.findall(r"[^\W\d_]{3,}", x["text"] or "")})
    out = []

    def misread(text: str, rate: float) -> str:
        return "".join(rng.choice("01ilorn;c@") if c.isalnum() and rng.random() < rate else c for c in text)

    for i, x in enumerate(pieces):
        text = x["text"] or ""
        lines = text.split("\n")
        genuine = i % 5 < 3
        if genuine:
            kind = rng.randrange(6)
            if kind == 1:
                text = misread(text, rng.uniform(0.01, 0.2))
            elif kind == 2 and len(lines) > 2:
                n = max(2, round(len(lines) * rng.uniform(0.4, 0.8)))
                at = rng.randint(0, len(lines) - n)
                text = "\n".join(lines[at : at + n])
            elif kind == 3:
                text = "Some of the page text stands above this piece of it.\n" + text + "\nAnd more of the text follows below it here."
            elif kind == 4:
                text = text[: round(len(text) * rng.uniform(0.4, 0.9))]
            elif kind == 5:
                text = re.sub(r"[ \n]+", " " if rng.random() < 0.5 else "", text)
        else:
            own = sorted(set(re.findall(r"[^\W\d_]{3,}", text)))
            new = {w: rng.choice(names) for w in rng.sample(own, -(-len(own) // rng.choice((2, 3, 4))))}
            text = re.sub(r"[^\W\d_]{3,}", lambda m: new.get(m.group(), m.group()), text)
            text = misread(re.sub(r"\d+", lambda m: str(rng.randint(1, 999)), text), rng.choice((0.0, 0.05)))
        name = re.sub(r"\.pdf$", "", (x["name"] or "").rsplit("/", 1)[-1])
        name = rng.choice([name + ".pdf", name.replace("_", " ").title(), name[: max(4, 2 * len(name) // 3)], None]) if name else None
        box, unit = x["box"], rng.choice((1.0, 0.48))
        out.append({
            "q": f"q{i}", "text": text, "name": name, "page": rng.choice((x["page"], x["page"], None, None if x["page"] is None else x["page"] + 1)),
            "context": misread(x["context"], 0.02) if x["context"] and rng.random() < 0.7 else None, "box": [v * unit for v in box] if box and rng.random() < 0.7 else None,
            "score": rng.choice((None, round(rng.uniform(0.6, 1.0), 4), round(rng.uniform(60, 100), 1))), "truth": x["d"] if genuine else None,
        })
    return out


def reliability(confidence: np.ndarray, right: np.ndarray, bins: int = 10) -> list[tuple[float, float, int]]:
    """(mean confidence, share that are right, pairs) of the pairs by tenths of confidence."""
    at = np.minimum((confidence * bins).astype(int), bins - 1)
    return [(float(confidence[at == k].mean()), float(right[at == k].mean()), int((at == k).sum())) for k in range(bins) if (at == k).any()]


def fit(features: np.ndarray, labels: np.ndarray, steps: int = 30, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge; features with the constant first."""
    w = np.zeros(features.shape[1])
    damp = ridge * np.eye(len(w))
    damp[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (labels - p) - damp @ w
        w = w + np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + damp, slope)
    return w
