"""Filling containers of fixed capacity with neighbouring documents along a space-filling curve.

Each document is encoded once and becomes its size and a point: the mean of
hashed directions of its tokens, in DIMENSIONS dimensions. The Hilbert key of the
point orders the corpus, so that neighbours on the curve have similar content.
The rows (document, size, key), without text, are range-sorted by key, and each
partition fills containers along the curve, best fit in blocks of documents; a
container that many others have followed is closed, so that what it holds lies close
together on the curve.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.tokenize import vocabulary, vocabulary_path
from sitelake.sources.tables import materialise

CAPACITY = 2048
DIMENSIONS, BITS = 3, 10
#: Documents that are ordered by size at a time, and how many containers back one may still be filled.
BLOCK, OPEN = 256, 128
SCHEMA = "container long, doc_id long, part int, n_parts int, start long, n_tokens long"


@lru_cache(2)
def directions(size: int) -> np.ndarray:
    """A fixed direction for each token id."""
    return np.random.default_rng(2048).standard_normal((size, DIMENSIONS))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dimensions) with coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_table(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, key) of each document with at least one token."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = vocabulary(path)
        known = directions(max(bpe.bytes_of) + 1)
        for batch in batches:
            ids = [bpe.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            flat = np.concatenate([np.asarray(ids[i], np.int64) for i in filled])
            starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
            mean = np.stack([np.add.reduceat(known[flat, d], starts) for d in range(DIMENSIONS)], 1) / sizes[filled][:, None]
            grid = np.clip((np.tanh(mean * 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(filled)), pa.array(sizes[filled]), pa.array(hilbert_key(grid))],
                names=["doc_id", "n_tokens", "key"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, key long")


class _Filler:
    """The last `window` containers by free space; the smallest that is large enough is found by one bit operation."""

    def __init__(self, capacity: int, first: int, window: int = OPEN):
        self.capacity, self.next, self.window, self.free, self.mask = capacity, first, window, {}, 0

    def put(self, size: int) -> int:
        room, container = self.capacity, None
        while container is None and (above := self.mask >> size):
            room = size + (above & -above).bit_length() - 1
            held = self.free[room]
            container = held.pop()
            if not held:
                self.mask &= ~(1 << room)
            if container < self.next - self.window:  # it lies too far back on the curve
                container = None
        if container is None:
            room, container = self.capacity, self.next
            self.next += 1
        if left := room - size:
            self.free.setdefault(left, []).append(container)
            self.mask |= 1 << left
        return container


def pack(sized: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(container, doc_id, part, n_parts, start, n_tokens) of (doc_id, n_tokens, key).

    A document of at most `capacity` tokens is one part; a larger one fills whole
    containers from its start and its rest is one part more. Documents without
    tokens take no room and have no row; a doc_id that repeats is packed each
    time. Containers are numbered by partition of the curve.
    """

    def run(batches):
        filler = None
        for pdf in batches:
            if filler is None and len(pdf):
                filler = _Filler(capacity, int(pdf["pid"].iloc[0]) << 40)
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                rows = []
                for doc, n in zip(part["doc_id"].tolist(), part["n_tokens"].tolist()):
                    whole, rest = divmod(n, capacity)
                    parts = whole + (rest > 0)
                    for k in range(parts):
                        start = k * capacity
                        rows.append((min(capacity, n - start), doc, k, parts, start))
                rows.sort(key=lambda r: -r[0])
                yield pd.DataFrame(
                    [(filler.put(size), doc, k, parts, start, size) for size, doc, k, parts, start in rows],
                    columns=["container", "doc_id", "part", "n_parts", "start", "n_tokens"],
                )

    ordered = sized.select("doc_id", "n_tokens", "key").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.withColumn("pid", F.spark_partition_id()).mapInPandas(run, SCHEMA)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """pack() of documents along the curve of their tokens.

    The sizes and keys are written once, as a range sort reads its input twice.
    """
    return pack(materialise(curve_table(documents, path)), capacity)


def split_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id): the documents that packing splits, those larger than a container."""
    return pack_documents(documents, capacity).where("part = 0 and n_parts > 1").select("doc_id")
