"""Encoding of a corpus with a public byte-level BPE tokenizer, by overlapping chunks.

A text of at most `chunk_chars` characters is one chunk. A longer one is cut into chunks that overlap: chunk k
starts at k * chunk_chars and reads on beyond the start of chunk k + 1. Every chunk is split into pre-tokens on
its own, wherever it lies. A pre-token pattern without look-behind goes on alike from any common boundary, so the
first boundary that two neighbours share in their overlap is a place where they are in step: there the
chunks are stitched, and the pieces between stitches are encoded on their own. Where two neighbours share no
boundary (one pre-token longer than the overlap) they form one piece. Ids equal those of the whole text;
decoding concatenates the ids' bytes.

Null and empty texts have an empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split of the public byte-level BPE vocabularies before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 8192
OVERLAP_CHARS = 512
#: A chunk reads this far beyond its overlap, so that no boundary in the overlap depends on the chunk's end.
MARGIN_CHARS = 64


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    encode = encoding(path).encode_ordinary
    return [encode(t) if t else [] for t in texts]


def decode_ids(ids: list[int], path: str = VOCABULARY) -> bytes:
    """The bytes of ids, concatenated; part of a text's ids may end within a character."""
    return encoding(path).decode_bytes(list(ids))


def decoded(ids, path: str = VOCABULARY):
    """Column of the bytes of arrays of ids; null for null."""

    def decode(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode_ids(x, path) for x in lists.to_pylist()], pa.binary())

    return F.arrow_udf(decode, "binary")(ids)


def ids_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoder(path: str):
    def encode(texts: pa.Array) -> pa.Array:
        return ids_array(encode_texts(texts.to_pylist(), path))

    return F.arrow_udf(encode, "array<int>")


def counter(path: str):
    """Number of ids of each text, without keeping the ids."""

    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(path).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int32())

    return F.arrow_udf(count, "int")


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of a text, and its end."""
    return [m.start() for m in splitter().finditer(text)] + [len(text)]


def chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, k, n, text) of overlapping chunks, cut in one pass over each text."""
    reach = chunk + overlap + MARGIN_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                n = -(-len(text) // chunk)
                for a in range(0, n, 256):
                    ks = range(a, min(n, a + 256))
                    yield pa.record_batch({
                        "doc": pa.array([doc] * len(ks), pa.int64()), "k": pa.array(ks, pa.int32()), "n": pa.array([n] * len(ks), pa.int32()),
                        "text": pa.array([text[k * chunk : k * chunk + reach] for k in ks], pa.string()),
                    })

    return long.mapInArrow(run, "doc bigint, k int, n int, text string")


def edges(chunk: int, overlap: int):
    """Boundaries of a chunk in the overlap at its start and in the one at its end, both counted from the overlap's start."""

    def find(texts: pa.Array) -> pa.Array:
        left, right = [], []
        for text in texts.to_pylist():
            at = boundaries(text)
            left.append([b for b in at if b < overlap])
            right.append([b - chunk for b in at if chunk <= b < chunk + overlap])
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["head", "tail"])

    return F.arrow_udf(find, "struct<head: array<int>, tail: array<int>>")


def pieces_of_long(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, piece, text): the pieces between stitches of each long text, in order."""
    spread = chunked(long, chunk, overlap).repartition("doc", "k")
    seen = spread.withColumn("edge", edges(chunk, overlap)("text"))
    order = Window.partitionBy("doc").orderBy("k")
    met = seen.withColumn("cut", F.array_min(F.array_intersect("edge.head", F.lag("edge.tail").over(order)))).drop("edge")
    met = met.withColumn("next", F.lead("cut").over(order))
    begin = F.coalesce("cut", F.lit(0))
    stop = F.when(F.col("k") == F.col("n") - 1, F.length("text")).otherwise(F.lit(chunk) + F.coalesce("next", F.lit(0)))
    cut = met.select("doc", "k", F.sum(F.when((F.col("k") == 0) | F.col("cut").isNotNull(), 1).otherwise(0)).over(order).alias("piece"), F.col("text").substr(begin + 1, F.greatest(stop - begin, F.lit(0))).alias("text"))
    return cut.groupBy("doc", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))


def encode_corpus(documents: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc, ids): one row for each row of documents, with the ids of its whole text.

    doc must be an integer unique to the row. Null and empty texts have an empty list; blank texts are text.
    Equal texts have equal ids; other columns are ignored; an empty table gives an empty table.
    Only long texts are shuffled: they are cut where they lie and their chunks spread over the cluster.
    """
    rows = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    encode = encoder(vocabulary)
    short = rows.where(~is_long).select("doc", encode("text").alias("ids"))
    pieces = pieces_of_long(rows.where(is_long), chunk_chars, overlap_chars).select("doc", "piece", encode("text").alias("ids"))
    long = pieces.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long).withColumnRenamed("doc", doc)
