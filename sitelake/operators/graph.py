"""The link graph: PageRank, status propagation and breadth-first levels as bounded DataFrame iterations."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.functions import urls
from sitelake.sources.tables import materialise


#: A node with so many links is a hub: its links are spread over SALTS tasks in each round.
HUB, SALTS = 10_000, 32
#: So many hubs are broadcast, at some 100 bytes each; more are joined by shuffle.
MOST_HUBS = 100_000


def _hubs(edges: DataFrame) -> DataFrame | None:
    """(src, hub) of the nodes with HUB links or more; None for none."""
    hubs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB).select("src", F.lit(True).alias("hub"))
    hubs = materialise(hubs)
    n = hubs.count()
    return None if not n else F.broadcast(hubs) if n <= MOST_HUBS else hubs


def _spread(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The edges, each hub's under several salts."""
    if hubs is None:
        return edges.withColumn("salt", F.lit(0))
    return edges.join(hubs, "src", "left").select("src", "dst", F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))


def _for_each_salt(nodes: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Rows of (src, ...) for a join with spread edges: a hub's under each salt."""
    if hubs is None:
        return nodes.withColumn("salt", F.lit(0))
    salts = F.sequence(F.lit(0), F.when(F.col("hub"), SALTS - 1).otherwise(0))
    return nodes.join(hubs, "src", "left").withColumn("salt", F.explode(salts)).drop("hub")


def edges_of(links: DataFrame) -> DataFrame:
    """(src, dst): distinct internal links, end slashes removed; self-loops stay, null ends don't."""
    return (
        links.where("is_external = 0 AND source_url IS NOT NULL AND target_url IS NOT NULL")
        .select(urls.without_end_slash(F.col("source_url")).alias("src"), urls.without_end_slash(F.col("target_url")).alias("dst"))
        .distinct()
    )


class NotConverged(RuntimeError):
    """An iteration reached its most rounds before its result was stable."""


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank) by power iteration; the rank of nodes without links is spread evenly.

    Stops when the ranks change by less than nodes * tolerance in all; where they
    still change by more after `rounds`, it raises NotConverged. tolerance None
    always takes `rounds`. An empty graph gives no row.
    """
    edges = materialise(edges)
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes = materialise(nodes.join(degree.withColumnRenamed("src", "node"), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    if (hubs := _hubs(edges)) is not None:
        edges = materialise(_spread(edges, hubs))
    on = ["src"] if hubs is None else ["src", "salt"]
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = ranks.where("degree IS NULL").agg(F.sum("rank").alias("r")).first()["r"] or 0.0
        parts = ranks.where("degree IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("part"))
        passed = (
            edges.join(parts if hubs is None else _for_each_salt(parts, hubs), on)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum("part").alias("got"))
        )
        fixed = (1 - damping) / n + damping * loose / n
        after = ranks.join(passed, "node", "left").select("node", "degree", (F.lit(fixed) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("before"))
        after = materialise(after)
        moved = after.agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("m")).first()["m"]
        ranks = after.drop("before")
        if tolerance is not None and moved < n * tolerance:
            break
    else:
        if tolerance is not None:
            raise NotConverged(f"the ranks still change by {moved} after {rounds} rounds")
    return ranks.select("node", "rank")


def log_scaled(ranks: DataFrame, digits: int = 4) -> DataFrame:
    """(node, score): the logarithm of the rank from 0 to 10, to `digits` decimals; 5 where all ranks are equal."""
    low, high = ranks.agg(F.min(F.ln("rank")), F.max(F.ln("rank"))).first()
    if low is None or high == low:
        return ranks.select("node", F.lit(5.0).alias("score"))
    return ranks.select("node", F.round((F.ln("rank") - F.lit(low)) / F.lit(high - low) * 10, digits).alias("score"))


def status_seeds(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """(node, status): the greater of the last page and the last request status of each URL, where above 0."""
    last = lambda df: df.groupBy(urls.without_end_slash(F.col("url")).alias("node")).agg(F.max_by("status_code", "id").alias("status"))
    both = last(pages.where("url IS NOT NULL")).unionByName(last(requests.where("url IS NOT NULL")))
    return both.where("status > 0").groupBy("node").agg(F.max("status").cast("int").alias("status"))


def propagate_status(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, status): the greatest status among the seeds that a node can be reached from, itself included.

    Each round only the nodes whose status rose send it on; as statuses only rise
    to one of the seeds', the rounds end.
    """
    edges = materialise(edges)
    if (hubs := _hubs(edges)) is not None:
        edges = materialise(_spread(edges, hubs))
    on = ["src"] if hubs is None else ["src", "salt"]
    best = materialise(seeds.select("node", "status"))
    risen = best
    while True:
        sending = risen.withColumnRenamed("node", "src")
        sent = edges.join(sending if hubs is None else _for_each_salt(sending, hubs), on).groupBy(F.col("dst").alias("node")).agg(F.max("status").alias("sent"))
        risen = materialise(
            sent.join(best, "node", "left").where("status IS NULL OR sent > status").select("node", F.col("sent").alias("status"))
        )
        if risen.isEmpty():
            return best
        best = materialise(best.unionByName(risen).groupBy("node").agg(F.max("status").alias("status")))


def levels(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level): the least number of links from any start, up to `depth`; without it, of every node that a start leads to."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = materialise(edges)
    seen = materialise(starts.select("node").where("node IS NOT NULL").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in count(1) if depth is None else range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = materialise(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = materialise(seen.unionByName(front).coalesce(parts))  # else each level adds partitions
    return seen
