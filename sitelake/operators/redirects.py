"""Redirects followed to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.sources.tables import materialise


def last_targets(hops: DataFrame) -> DataFrame:
    """(source, target): of (id, position, source, target) the target that each source was sent to last; null ends are left out."""
    rows = hops.where("source IS NOT NULL AND target IS NOT NULL")
    return rows.groupBy("source").agg(F.max_by("target", F.struct("id", "position")).alias("target"))


def walk(starts: DataFrame, redirects: DataFrame, most: int = 5) -> DataFrame:
    """(url, final_url, hops, outcome) of (url): each start's way along (source, target), one target a source.

    outcome: final where no redirect goes on, loop where a URL comes again (final_url
    is that URL), too_many where a redirect is left after `most` hops. Null starts
    are left out; repeated ones count once. Each round joins only the ways that go on.
    """
    redirects = materialise(redirects.select("source", "target"))
    going = starts.where("url IS NOT NULL").select("url").distinct().select("url", F.col("url").alias("at"), F.array("url").alias("seen"), F.lit(None).cast("string").alias("outcome"))
    done = None
    for hop in range(most + 1):
        step = going.join(redirects, F.col("at") == F.col("source"), "left")
        outcome = F.when(F.col("target").isNull(), "final").when(F.lit(hop == most), "too_many").when(F.array_contains("seen", F.col("target")), "loop")
        moved = materialise(
            step.select("url", F.when(outcome.isin("final", "too_many"), F.col("at")).otherwise(F.col("target")).alias("at"), F.concat("seen", F.array("target")).alias("seen"), outcome.alias("outcome"), F.lit(hop).alias("n"))
        )
        ended = moved.where("outcome IS NOT NULL").select("url", F.col("at").alias("final_url"), (F.col("n") + (F.col("outcome") == "loop").cast("int")).alias("hops"), "outcome")
        done = ended if done is None else done.unionAll(ended)
        going = moved.where("outcome IS NULL").select("url", "at", "seen", "outcome")
        if going.isEmpty():
            break
    return done
