"""Words and n-grams of texts: counted, ranked and cut per text."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words that carry no topic, English and Dutch; callers may give their own.
STOP_WORDS = (
    "the and for that with this from are was were has have had not but you your our they their its his her she him who which what when where will would can could "
    "all any been being both each into more most other over same some such than then there these those through under until while about after again before between "
    "een het van voor met die dat deze dit niet aan als bij door naar nog ook om op over te tot uit wat wel zijn zo er en de der in is ik je of maar men "
    "an as at be by do he if it me my no of on or so to up us we am"
).split()


def words(text: Column) -> Column:
    """Lower-case words of Latin-1 letters and digits, bounded by other characters than letters, digits and '_'."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z0-9à-öø-ÿ]+$"))


def topical(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """words() of two letters or more that are no stop words; n-grams bridge what is left out."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def stop_list(*lists: list[str]) -> list[str]:
    """All words of several lists, in lower case; entries of several words can never be met and are left out."""
    return sorted({w.lower() for words_ in lists for w in words_ if len(w.split()) == 1})


def top_ngrams(texts: DataFrame, n: int, top: int = 20, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(id, gram, n_times, rank) of (id, text): the `top` most frequent n-grams of each text.

    Of the 3 * top most frequent, ties by first place and then by text, those
    without a letter are dropped and the first `top` stay. Null texts have none. A
    row is counted by itself, so that nothing is shuffled; a repeated id has its
    n-grams each time.
    """

    def run(batches):
        for batch in batches:
            ids, grams, times, ranks = [], [], [], []
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(w if n == 1 else map(" ".join, zip(*(w[j:] for j in range(n)))))  # in order of first place
                near = sorted(counts.items(), key=lambda x: -x[1])[: 3 * top]
                kept = [x for x in near if any(map(str.isalpha, x[0]))][:top]
                ids += [i] * len(kept)
                grams += [g for g, _ in kept]
                times += [t for _, t in kept]
                ranks += range(1, len(kept) + 1)
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(grams, pa.string()), pa.array(times, pa.int64()), pa.array(ranks, pa.int32())], names=["id", "gram", "n_times", "rank"])

    split = texts.where("text IS NOT NULL").select("id", topical(F.col("text"), stop).alias("w")).where(F.size("w") >= n)
    return split.mapInArrow(run, f"id {split.schema['id'].dataType.simpleString()}, gram string, n_times long, rank int")


def stored(grams: DataFrame) -> DataFrame:
    """(id, content): a text's n-grams and their numbers as one JSON object."""
    return grams.groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("gram", "n_times")))).alias("content"))


def read_stored(rows: DataFrame) -> DataFrame:
    """(id, gram, n_times) of (id, content); broken content has none."""
    return rows.select("id", F.explode(F.from_json("content", "map<string,int>")).alias("gram", "n_times"))
