"""Per-key results where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets in which heavy keys are looked for. Their counts are one row a
#: bucket and map task, whatever the number of keys.
BUCKETS = 1 << 16
#: A bucket with at least this share of all rows holds a heavy key, so there
#: are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.002
#: Into how many parts the rows of a heavy key are spread.
SALTS = 64


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def heavy_buckets(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> list[int]:
    """Buckets of keys that hold at least `share` of the rows; every row is counted.

    At most 1 / share numbers reach the driver.
    """
    counts = df.groupBy(bucket_of(keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("all"))  # BUCKETS pairs at most
    heavy = F.filter("all", lambda x: x["n"] >= F.greatest(F.lit(1.0), F.col("total") * share))
    return list(whole.select(F.coalesce(F.transform(heavy, lambda x: x["bucket"]), F.array())).first()[0])


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Sequence[Column],
    merge: Sequence[Column],
    salt_by: Sequence[str],
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """groupBy(keys) in two stages, the rows of heavy keys spread over `salts` tasks.

    partial: aggregates over the rows, computed per key and salt. merge: aggregates
    over the partial columns that give the final ones. salt_by: columns that tell
    rows of one key apart (a row id); the salt is their hash, so that a task that
    runs again gives the same salt. Rows of light keys have salt 0.

    Null keys form a group of their own, as in groupBy; an empty table gives no
    row; repeated rows count each time. Other columns of `df` are ignored,
    whatever their names.
    """
    heavy = heavy_buckets(df, keys, share)
    hashed = F.pmod(F.xxhash64(*salt_by, F.lit(7)), F.lit(salts)).cast("int")
    salt = F.when(bucket_of(keys).isin(heavy), hashed).otherwise(0) if heavy else F.lit(0)
    parts = df.groupBy(*keys, salt.alias("__salt")).agg(*partial)
    return parts.groupBy(*keys).agg(*merge)


def link_ends(links: DataFrame) -> DataFrame:
    """One row (id, side, url) for each end of each link, from one scan."""
    ends = F.array(
        F.struct(F.lit("source_url").alias("side"), F.col("source_url").alias("url")),
        F.struct(F.lit("target_url").alias("side"), F.col("target_url").alias("url")),
    )
    return links.select("id", F.explode(ends).alias("e")).select("id", "e.side", "e.url")


def url_link_counts(links: DataFrame) -> DataFrame:
    """(url, in_links, out_links): rows of `links` that point to and from each URL, as stored.

    Null ends belong to no URL and are left out; '' is a URL like any other.
    """
    counts = _end_counts(links)
    return (
        counts.where("url is not null")
        .groupBy("url")
        .agg(
            F.sum(F.when(F.col("side") == "target_url", F.col("n")).otherwise(0)).alias("in_links"),
            F.sum(F.when(F.col("side") == "source_url", F.col("n")).otherwise(0)).alias("out_links"),
        )
    )


def _end_counts(links: DataFrame) -> DataFrame:
    return salted_aggregate(
        link_ends(links),
        ["side", "url"],
        [F.count(F.lit(1)).alias("n")],
        [F.sum("n").alias("n")],
        ["id"],
    )


def url_neighbour_counts(links: DataFrame) -> DataFrame:
    """(url, linking_pages, linked_targets): distinct sources that point to each URL and distinct targets it points to.

    The distinct pairs are spread by pair, not by URL, before a count per URL
    that is combined on the map side. Null ends are left out.
    """
    pairs = links.select("source_url", "target_url").where("source_url is not null and target_url is not null").distinct()
    ends = F.array(
        F.struct(F.col("target_url").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("source_url").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )
    return (
        pairs.select(F.explode(ends).alias("e"))
        .groupBy("e.url")
        .agg(F.sum("e.i").alias("linking_pages"), F.sum("e.o").alias("linked_targets"))
    )


def heavy_urls(links: DataFrame, share: float = 0.03) -> DataFrame:
    """(side, url): URLs that hold at least `share` of all rows of `links` in that column, null ends counted in the total."""
    least = links.count() * share
    return _end_counts(links).where((F.col("url").isNotNull()) & (F.col("n") >= least)).select("side", "url")
