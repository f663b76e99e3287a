"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.sources.tables import materialise

#: Spellings of one URL that meet in one task when pairs are formed; larger classes are split.
SPLIT = 500
#: So many split classes are broadcast, at some 50 bytes each; more are joined by shuffle.
MOST_BROADCAST = 50_000
#: All but letters and digits of any script.
_IGNORED = r"[^\p{L}\p{N}]"


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _IGNORED, "")


def canonical_url(url: Column) -> Column:
    """The URL without letter case, white space and punctuation, its query fields in order.

    The part before the first '?' and each piece between '&' after it keep only
    lower-case letters and digits; pieces that are then empty don't count. '?' and
    '&' are left as separators, so different splits stay different. Null for null.
    """
    at = F.instr(url, "?")
    head = F.when(at > 0, F.substring_index(url, "?", 1)).otherwise(url)
    query = F.when(at > 0, F.expr("substring(__u, instr(__u, '?') + 1)")).otherwise(F.lit(""))
    pieces = F.array_sort(F.filter(F.transform(F.split(query, "&"), _bare), lambda p: p != ""))
    return F.concat(_bare(head), F.lit("?"), F.array_join(pieces, "&"))


def _with_canonical(df: DataFrame) -> DataFrame:
    keyed = df.withColumn("canonical", canonical_url(F.col("__u")))
    hashed = F.md5(F.encode("canonical", "UTF-8"))
    return keyed.withColumn("key", F.coalesce(F.unhex(hashed), F.lit(b"")))  # never null, else joins test the scanned rows for it


def stored_spellings(fields: dict[str, DataFrame]) -> DataFrame:
    """(field, url, n): each different stored string of each field with its rows, counted with map-side combining."""
    parts = [df.select(F.lit(name).alias("field"), F.col(df.columns[0]).alias("url")) for name, df in fields.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.where("url is not null").groupBy("field", "url").agg(F.count(F.lit(1)).alias("n"))


def collapse_urls(fields: dict[str, DataFrame]) -> DataFrame:
    """(field, url, spellings, copies): one row for each URL of each field.

    fields: name -> table of one column of URLs. url is the first stored spelling
    in byte order, spellings how many different ones there are, copies how many
    rows. Null URLs are no record; blank ones are one record. Two URLs that share
    a 128-bit hash stay apart, as groups are kept by hash and canonical form.
    """
    keyed = _with_canonical(stored_spellings(fields).withColumn("__u", F.col("url")))
    return (
        keyed.groupBy("field", "key", "canonical")
        .agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("copies"))
        .select("field", "url", "spellings", "copies")
    )


def spelling_pairs(fields: dict[str, DataFrame]) -> DataFrame:
    """(field, url_a, url_b), url_a < url_b in byte order: different stored strings that are the same URL.

    The different strings are written once with the 128-bit hash of their canonical
    form and a second hash of 64 bits, and joined on the first; pairs whose second
    hashes differ are a collision and dropped. A class of more than SPLIT spellings
    is spread over several tasks: each of its strings goes to one part as the first
    of a pair and to all parts as the second.
    """
    keyed = _with_canonical(stored_spellings(fields).withColumn("__u", F.col("url")))
    keyed = materialise(keyed.select("field", "key", F.xxhash64("canonical", F.lit("second")).alias("check"), "url"))
    large = keyed.groupBy("field", "key").agg(F.count(F.lit(1)).alias("spellings")).where(F.col("spellings") > SPLIT)
    large = materialise(large.select("field", "key", F.ceil(F.col("spellings") / SPLIT).cast("int").alias("parts")))
    n_large = large.count()
    if n_large:
        keyed = keyed.join(F.broadcast(large) if n_large <= MOST_BROADCAST else large, ["field", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        keyed = keyed.withColumn("parts", F.lit(1))
    a = keyed.select("field", "key", "check", F.pmod(F.xxhash64("url"), "parts").cast("int").alias("part"), F.col("url").alias("url_a"))
    b = keyed.select(
        F.col("field").alias("field_b"), F.col("key").alias("key_b"), F.col("check").alias("check_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"), F.col("url").alias("url_b")
    )
    same = (F.col("field") == F.col("field_b")) & (F.col("key") == F.col("key_b")) & (F.col("part") == F.col("part_b"))
    return a.join(b, same & (F.col("check") == F.col("check_b")) & (F.col("url_a") < F.col("url_b"))).select("field", "url_a", "url_b")
