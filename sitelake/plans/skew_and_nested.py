"""Queries of the core operators for uneven keys (p1) and nested records (p6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.operators import nested, skew
from sitelake.sources.tables import read_spread, read_table

_COLUMNS = ("id", "source_url", "target_url")


def p1_found(spark, root):
    return skew.heavy_urls(read_table(spark, root, "links", *_COLUMNS))


def p1_link_counts(spark, root):
    return skew.url_link_counts(read_table(spark, root, "links", *_COLUMNS))


def p1_neighbour_counts(spark, root):
    return skew.url_neighbour_counts(read_table(spark, root, "links", *_COLUMNS))


def _nested(spark, root, form):
    requests = read_spread(spark, root, "requests", "id", "redirect_chain", "headers", "timers")
    return nested.nested_fields(requests, read_spread(spark, root, "audit_issues", "id", "details"), form)


def p6_found(spark, root):
    return _nested(spark, root, "found")


def p6_nodes(spark, root):
    return _nested(spark, root, "nodes")


def p6_objects(spark, root):
    return _nested(spark, root, "objects")


def p6_redirects(spark, root):
    """The flat table of requests.redirect_chain: one row for each hop."""
    hops = nested.flatten_nested(read_table(spark, root, "requests", "id", "redirect_chain"), "id", {"redirect_chain": "redirect_chain"}, "objects")
    m = lambda k: F.col("members")[k]
    hop = hops.where("shape = '*'").select(F.col("record_id").alias("request_id"), "position", m("source").alias("source"), m("target").alias("target"), m("status").try_cast("int").alias("status"), m("final_url").alias("final_url"), m("error").alias("error"))
    return hop


QUERIES = {
    "p1_found": p1_found,
    "p1_link_counts": p1_link_counts,
    "p1_neighbour_counts": p1_neighbour_counts,
    "p6_found": p6_found,
    "p6_nodes": p6_nodes,
    "p6_objects": p6_objects,
    "p6_redirects": p6_redirects,
}

SQL = {
    "p1_found": """
        WITH ends AS (
          SELECT 'source_url' AS side, source_url AS url FROM links
          UNION ALL SELECT 'target_url', target_url FROM links)
        SELECT side, url FROM ends WHERE url IS NOT NULL
        GROUP BY side, url HAVING count(*) >= 0.03 * (SELECT count(*) FROM links)""",
    "p1_link_counts": """
        SELECT url, CAST(sum(i) AS BIGINT) AS in_links, CAST(sum(o) AS BIGINT) AS out_links FROM (
          SELECT target_url AS url, 1 AS i, 0 AS o FROM links
          UNION ALL SELECT source_url, 0, 1 FROM links)
        WHERE url IS NOT NULL GROUP BY url""",
    "p1_neighbour_counts": """
        WITH pairs AS (SELECT DISTINCT source_url, target_url FROM links
                       WHERE source_url IS NOT NULL AND target_url IS NOT NULL)
        SELECT url, CAST(sum(i) AS BIGINT) AS linking_pages, CAST(sum(o) AS BIGINT) AS linked_targets FROM (
          SELECT target_url AS url, 1 AS i, 0 AS o FROM pairs
          UNION ALL SELECT source_url, 0, 1 FROM pairs)
        GROUP BY url""",
}
