"""Near-duplicate texts: fingerprints split into blocks, joined on blocks, verified by Hamming distance.

A fingerprint has COMPONENTS minimum-hash components of the text's shingles, so
that the share of components in which two fingerprints differ follows one minus
their Jaccard similarity. Pigeonhole: of BLOCKS blocks, a pair that differs in
fewer components than there are blocks must share one whole block; pairs with
more differing components share one with a probability that PERMUTATIONS and BINS
set (0.9987 at a similarity of 0.6). A row of a block carries its text's sketch of
one bit a component, so that the join itself compares Hamming distances and writes
only close pairs; these are compared by four bits a component, and what remains by
the exact similarity of the texts. A block that many texts share is spread over
several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.operators.components import connected_components
from sitelake.sources.tables import materialise

#: Components of a fingerprint: the minimum of each of BINS bins under each permutation.
PERMUTATIONS, BINS = 12, 16
#: Components of a block, each of another permutation.
BLOCK = 4
BLOCKS = PERMUTATIONS * BINS // BLOCK
#: Bits of a sketch: one of each component.
SKETCH_BITS = PERMUTATIONS * BINS
#: So many ids of texts to compare are broadcast, at 8 bytes each; more are joined by shuffle.
MOST_BROADCAST_IDS = 500_000
#: Characters of text that are hashed at a time.
SLICE_BYTES = 8_000_000
#: Copies of one text from which its rows are spread, and texts of a block that meet in one task.
HOT_CLASS, BLOCK_TEXTS = 1000, 400
#: Block sizes are estimated from one text in so many; they only decide how a block is spread.
SIZE_SAMPLE = 16
#: Hot texts or blocks that are broadcast, at some 30 bytes each; more are joined by shuffle.
MOST_BROADCAST_HOT = 100_000
_WHITE = "[ \t\n\r]+"
_SPLIT = re.compile(_WHITE)
WORDS = SKETCH_BITS // 64
_SKETCH = [f"s{k}" for k in range(WORDS)]
#: Words of the components' low four bits, sixteen a word.
_NIBBLES = [f"g{k}" for k in range(SKETCH_BITS // 16)]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of `words` words, in order, over all texts at once."""
    import xxhash

    split = pc.split_pattern_regex(pc.fill_null(texts, ""), _WHITE)
    flat, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
    filled = pc.greater(pc.utf8_length(flat), 0)
    parent, flat = parent[filled.to_numpy(zero_copy_only=False)], flat.filter(filled)
    if len(flat) < words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashed = known[coded.indices.to_numpy()]
    n = len(hashed) - words + 1
    total = np.zeros(n, np.uint64)
    for j, c in enumerate(_constants(words, 11)):
        total = (total + hashed[j : j + n]) * (c | np.uint64(1))
    whole = parent[:n] == parent[words - 1 :]
    return parent[:n][whole], _mixed(total[whole])


def fingerprints(text_of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, PERMUTATIONS, BINS) components. Each hash falls into one bin of each permutation; an empty bin takes the value of a filled one that its own number picks."""
    out = np.empty((n, PERMUTATIONS, BINS), np.uint64)
    bits = np.uint64(64 - BINS.bit_length() + 1)
    order = np.array([[int(x) % BINS for x in _constants(64, 1000 + b)] for b in range(BINS)])
    nothing = np.iinfo(np.uint64).max
    for p, seed in enumerate(_constants(PERMUTATIONS, 77)):
        v = _mixed(hashes ^ seed)
        least = np.full(n * BINS, nothing, np.uint64)
        np.minimum.at(least, text_of * BINS + (v >> bits).astype(np.int64), v)
        least = least.reshape(n, BINS)
        empty = least == nothing
        filled = least.copy()
        rows, bins = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
        for turn in range(order.shape[1]):
            if not len(rows):
                break
            source = order[bins, turn]
            hit = ~empty[rows, source]
            filled[rows[hit], bins[hit]] = least[rows[hit], source[hit]]
            rows, bins = rows[~hit], bins[~hit]
        out[:, p] = filled
    return out


def _blocks(prints: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) hashes of the blocks, each mixed with its number."""
    n = len(prints)
    grouped = prints.reshape(n, PERMUTATIONS // BLOCK, BLOCK, BINS)
    total = np.zeros((n, PERMUTATIONS // BLOCK, BINS), np.uint64)
    for j in range(BLOCK):
        total = _mixed(total * np.uint64(31) + grouped[:, :, j])
    return _mixed(total.reshape(n, BLOCKS) ^ _constants(BLOCKS, 5)[None, :]) >> np.uint64(24)  # 40 bits, for a smaller shuffle; what they let through is compared anyway


def _sketch(prints: np.ndarray) -> np.ndarray:
    """(n, WORDS) words of one bit for each of the first SKETCH_BITS components."""
    bits = (_mixed(prints.reshape(len(prints), -1)[:, :SKETCH_BITS]) >> np.uint64(17)) & np.uint64(1)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.stack([(bits[:, k * 64 : k * 64 + 64] * weights).sum(axis=1, dtype=np.uint64) for k in range(WORDS)], axis=1)


def _nibbles(prints: np.ndarray) -> np.ndarray:
    """(n, len(_NIBBLES)) words of four bits of each component."""
    low = (_mixed(prints.reshape(len(prints), -1)) >> np.uint64(23)) & np.uint64(15)
    shifts = np.uint64(4) * np.arange(16, dtype=np.uint64)
    return (low.reshape(len(prints), -1, 16) << shifts).sum(axis=2, dtype=np.uint64)


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def fingerprint_table(texts: DataFrame, words: int) -> DataFrame:
    """(id, blocks, sketch, nibbles) of (id, text); texts with fewer words than a shingle have no row."""
    longs = [*_SKETCH, *_NIBBLES]

    def run(batches):
        for whole in batches:
            for batch in _sliced(whole, 1):
                text_of, hashes = shingle_hashes(batch.column(1), words)
                present, compact = np.unique(text_of, return_inverse=True)
                if not len(present):
                    continue
                prints = fingerprints(compact, hashes, len(present))
                numbers = np.concatenate([_sketch(prints), _nibbles(prints)], axis=1).view(np.int64)
                blocks = pa.FixedSizeListArray.from_arrays(pa.array(_blocks(prints).view(np.int64).ravel()), BLOCKS).cast(pa.list_(pa.int64()))
                ids = batch.column(0).take(pa.array(present))
                yield pa.record_batch([ids, blocks, *[pa.array(numbers[:, k].copy()) for k in range(len(longs))]], names=["id", "blocks", *longs])

    return texts.mapInArrow(run, "id long, blocks array<long>, " + ", ".join(f"{c} long" for c in longs))


def most_differing(parts: int, similarity: float, chance: float, deviations: float = 3.2) -> int:
    """Of `parts` parts of two fingerprints, in how many a pair of at least `similarity` differs, but for one in 1,400; parts of different components agree by `chance`."""
    p = (1 - similarity) * (1 - chance)
    return int(np.ceil(parts * p + deviations * (parts * p * (1 - p)) ** 0.5))


def shingle_set(text: str, words: int) -> set[tuple[str, ...]]:
    split = [w for w in _SPLIT.split(text) if w]
    return set(zip(*(split[j:] for j in range(words))))


def shingle_numbers(text: str, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; they compare within one process only."""
    split = [w for w in _SPLIT.split(text) if w]
    return np.unique(np.fromiter(map(hash, zip(*(split[j:] for j in range(words)))), np.int64))


#: Texts whose shingle hashes a task keeps, some 8 bytes a word each.
KEPT_TEXTS = 4096


def verify(pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, similarity) of (a, b, ta, tb): the exact Jaccard similarity of the texts' shingles, where it is large enough."""

    def run(batches):
        numbers = lru_cache(KEPT_TEXTS)(lambda text: shingle_numbers(text, words))
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = numbers(ta), numbers(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both < 0.99 * similarity * (len(x) + len(y) - both):
                    continue
                x, y = shingle_set(ta, words), shingle_set(tb, words)  # exact, whatever the hashes
                both = len(x & y)
                if x and y and (j := both / (len(x) + len(y) - both)) >= similarity:
                    rows.append((a, b, j))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def classes_of(texts: DataFrame) -> DataFrame:
    """(id, rep): the least id with the same text, for each row of (id, text); null texts are left out.

    Texts are compared by two hashes of 64 bits. The rows of a text with HOT_CLASS
    copies or more meet their class by broadcast and stay where they are.
    """
    keyed = texts.where("text is not null and id is not null").select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    reps = materialise(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    hot = reps.where(F.col("copies") >= HOT_CLASS).select("h1", "h2", F.col("rep").alias("hot_rep"))
    n_hot = hot.count()
    if n_hot and n_hot <= MOST_BROADCAST_HOT:
        keyed = keyed.join(F.broadcast(hot), ["h1", "h2"], "left")
        cold = reps.where(F.col("copies") < HOT_CLASS)
    else:
        keyed, cold = keyed.withColumn("hot_rep", F.lit(None).cast("long")), reps
    spread = keyed.withColumn("h1", F.when(F.col("hot_rep").isNotNull(), F.xxhash64("id")).otherwise(F.col("h1")))
    found = spread.join(cold.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    return found.select("id", F.coalesce("hot_rep", "rep", "id").alias("rep")).distinct()


def _by_count(df: DataFrame, most: int) -> DataFrame:
    """`df` for a join, broadcast where it has no more than `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _close_in_blocks(table: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: texts that share a block and whose sketches are close; pairs repeat.

    A block of more than about BLOCK_TEXTS texts is spread over several tasks: each
    text goes to one part as the first of a pair and to all parts as the second.
    """
    far = " + ".join(f"bit_count({c} ^ t{c})" for c in _SKETCH)
    near = F.expr(f"a < b AND {far} <= {most_differing(SKETCH_BITS, similarity, 0.5)}")
    blocks = table.select("id", F.explode("blocks").alias("block"), *_SKETCH)
    first = lambda df, *more: df.select("block", *more, F.col("id").alias("a"), *_SKETCH)
    second = lambda df, *more: df.select("block", *more, F.col("id").alias("b"), *[F.col(c).alias(f"t{c}") for c in _SKETCH])

    sizes = blocks.where(F.pmod(F.xxhash64("id"), F.lit(SIZE_SAMPLE)) == 0).groupBy("block").agg((F.count(F.lit(1)) * SIZE_SAMPLE).alias("texts"))
    large = materialise(sizes.where(F.col("texts") > BLOCK_TEXTS).select("block", F.ceil(F.col("texts") / BLOCK_TEXTS).cast("int").alias("parts")))
    if large.isEmpty():
        return first(blocks).join(second(blocks), "block").where(near).select("a", "b")
    large = _by_count(large, MOST_BROADCAST_HOT)
    small, hot = blocks.join(large, "block", "left_anti"), blocks.join(large, "block")
    parts = first(hot, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")).join(second(hot, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["block", "part"])
    return first(small).join(second(small), "block").where(near).select("a", "b").unionAll(parts.where(near).select("a", "b"))


def similar_classes(texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, rep) of each text, and (a, b, similarity), a < b, of class representatives at or above `similarity`.

    texts: (id, text). A class is the rows with exactly the same text; a hot class
    is one row from here on.
    """
    members = materialise(classes_of(texts))
    table = fingerprint_table(texts.where("text is not null and id is not null").select("id", "text"), words)
    copies = members.where("id <> rep").select("id")
    table = materialise(table.join(_by_count(copies, MOST_BROADCAST_IDS), "id", "left_anti"))
    close = _close_in_blocks(table, similarity).distinct()
    nibbles = table.select("id", *_NIBBLES)
    both = close.join(nibbles.withColumnRenamed("id", "a"), "a").join(nibbles.toDF("b", *[f"t{c}" for c in _NIBBLES]), "b")
    once = "array(" + ", ".join(f"{c} ^ t{c}" for c in _NIBBLES) + ")"
    apart = f"aggregate({once}, 0, (n, x) -> n + bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441L))"
    close = materialise(both.where(F.expr(f"{apart} <= {most_differing(SKETCH_BITS, similarity, 1 / 16)}")).select("a", "b"))

    used = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    used_texts = texts.join(_by_count(used, MOST_BROADCAST_IDS), "id", "left_semi").select("id", "text").dropDuplicates(["id"])
    pairs = (
        close.join(used_texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(used_texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    return members, verify(pairs, words, similarity)


def near_pairs(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs of class representatives, and each copy with its representative.

    Words are runs of characters other than space, tab, LF and CR; a text stands
    for its distinct runs of `words` words. Texts with fewer words are in no pair,
    nor are null texts. Copies of one text are linked to the copy of least id
    only, at similarity 1; every other link is between different texts.
    """
    members, pairs = similar_classes(texts, words, similarity)
    long_enough = F.size(F.filter(F.split("text", _WHITE), lambda w: w != "")) >= words
    copies = members.where("id <> rep")
    counted = texts.where("text is not null").where(long_enough).select("id").join(copies, "id").distinct()
    return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "similarity").unionByName(
        counted.select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    )


def near_groups(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, group_id, links): one row for each text; group_id is the least id that links of at least `similarity` lead to, links the number of other representatives that the text's class is linked with."""
    members, pairs = similar_classes(texts, words, similarity)
    pairs = materialise(pairs.select("a", "b"))
    groups = connected_components(pairs).withColumnsRenamed({"node": "rep", "component": "group_id"})
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(groups, "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
