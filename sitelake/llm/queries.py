"""Queries of the operators for training text, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.llm import canonical, encoding, main_content, neardup, packing, pii, quantiles, tokenize
from sitelake.sources.tables import materialise, read_spread, read_table


def p2_found(spark, root):
    return quantiles.slow_or_failing_groups(read_table(spark, root, "requests", "project_id", "status_code", "elapsed_time", "created_at"))


def p2_percentiles(spark, root):
    requests = read_table(spark, root, "requests", "project_id", "status_code", "elapsed_time", "created_at")
    counts = materialise(quantiles.value_counts(quantiles.request_values(requests), ["project_id", "measure"]))
    found = quantiles.quantiles(counts, ["project_id", "measure"], [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    return found.withColumn("quantile", F.round("quantile", 6))


def _contents(spark, root):
    return read_spread(spark, root, "pages", "id", "content").toDF("id", "text")


def p3_found(spark, root):
    return encoding.label_pages(_contents(spark, root)).select(F.col("id").alias("page_id"))


def p3_restored(spark, root):
    restored = encoding.label_pages(_contents(spark, root), restore=True)
    return restored.select(F.col("id").alias("page_id"), "states", "complete", F.col("text").alias("content"))


def p5_found(spark, root):
    return main_content.main_blocks(_contents(spark, root)).select(F.col("id").alias("page_id"), "block_no")


def p5_texts(spark, root):
    return main_content.main_blocks(_contents(spark, root), with_text=True).select(F.col("id").alias("page_id"), "text")


def _body_texts(spark, root):
    return read_table(spark, root, "htmldocument", "page_id", "body_text").toDF("id", "text")  # read several times, so never spread


def p4_found(spark, root):
    pairs = neardup.near_pairs(_body_texts(spark, root), words=3, similarity=0.6)
    return pairs.select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p4_groups(spark, root):
    return neardup.near_groups(_body_texts(spark, root)).withColumnRenamed("id", "page_id")


def p4_content_groups(spark, root):
    """As p4_groups, over whole pages.content; body_text holds the first 5,000 characters only."""
    return neardup.near_groups(read_table(spark, root, "pages", "id", "content").toDF("id", "text")).withColumnRenamed("id", "page_id")


def _url_fields(spark, root):
    return {
        "links.target_url": read_table(spark, root, "links", "target_url"),
        "pages.url": read_table(spark, root, "pages", "url"),
    }


def p7_found(spark, root):
    return canonical.spelling_pairs(_url_fields(spark, root))


def p7_collapsed(spark, root):
    return canonical.collapse_urls(_url_fields(spark, root))


def p8_ids(spark, root):
    return tokenize.encode_documents(read_spread(spark, root, "documents", "doc_id", "text"))


def p8_texts(spark, root):
    """The round trip: each document's text from its ids."""
    return tokenize.decode_documents(p8_ids(spark, root))


def p9_found(spark, root):
    return packing.split_documents(read_spread(spark, root, "documents", "doc_id", "text"))


def p9_containers(spark, root):
    return packing.pack_documents(read_spread(spark, root, "documents", "doc_id", "text"))


def _documents_and_names(spark, root):
    return read_spread(spark, root, "documents", "doc_id", "text"), read_table(spark, root, "given_names", "given_name")


def p10_found(spark, root):
    return pii.items(*_documents_and_names(spark, root))


def p10_redacted(spark, root):
    return pii.redacted(*_documents_and_names(spark, root))


QUERIES = {
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p4_content_groups": p4_content_groups,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p7_found": p7_found,
    "p7_collapsed": p7_collapsed,
    "p8_ids": p8_ids,
    "p8_texts": p8_texts,
    "p9_found": p9_found,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_VALUES = """
    SELECT project_id, strftime(created_at, '%Y-%m-%d') AS day, 'elapsed_time' AS measure, elapsed_time AS value FROM requests
    WHERE elapsed_time IS NOT NULL AND NOT isnan(elapsed_time) AND elapsed_time >= 0
    UNION ALL
    SELECT project_id, strftime(created_at, '%Y-%m-%d'), 'status_code', CAST(status_code AS DOUBLE) FROM requests
    WHERE status_code > 0"""
_CANONICAL = r"""
    regexp_replace(lower(split_part(url, '?', 1)), '[^\p{L}\p{N}]', '', 'g') || '?' || array_to_string(list_sort(list_filter(
      list_transform(string_split(CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) ELSE '' END, '&'),
        lambda p: regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g')), lambda p: p <> '')), '&')"""
_SPELLINGS = f"""
    SELECT field, url, n, {_CANONICAL} AS canonical FROM (
      SELECT 'links.target_url' AS field, target_url AS url, count(*) AS n FROM links WHERE target_url IS NOT NULL GROUP BY target_url
      UNION ALL SELECT 'pages.url', url, count(*) FROM pages WHERE url IS NOT NULL GROUP BY url)"""

SQL = {
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": f"""
        WITH v AS ({_VALUES}),
        whole AS (SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM v WHERE measure = 'elapsed_time'),
        days AS (SELECT project_id, day, measure, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
                        quantile_cont(value, 0.95) AS p95 FROM v GROUP BY project_id, day, measure HAVING count(*) >= 40)
        SELECT project_id, day, 'elapsed_p50' AS measure FROM days, whole WHERE days.measure = 'elapsed_time' AND days.p50 >= 2 * whole.p50
        UNION ALL SELECT project_id, day, 'elapsed_p95' FROM days, whole WHERE days.measure = 'elapsed_time' AND days.p95 >= 6 * whole.p95
        UNION ALL SELECT project_id, day, 'status_p75' FROM days WHERE measure = 'status_code' AND p75 >= 400""",
    "p2_percentiles": f"""
        WITH v AS ({_VALUES}), ps AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS p),
        q AS (SELECT project_id, measure, count(*) AS n_values,
                     quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS qs FROM v GROUP BY project_id, measure)
        SELECT project_id, measure, unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS p, n_values, round(unnest(qs), 6) AS quantile FROM q""",
    "p7_found": f"""
        WITH s AS ({_SPELLINGS})
        SELECT a.field, a.url AS url_a, b.url AS url_b FROM s a JOIN s b
        ON a.field = b.field AND a.canonical = b.canonical AND a.url < b.url""",
    "p7_collapsed": f"""
        WITH s AS ({_SPELLINGS})
        SELECT field, min(url) AS url, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS copies FROM s GROUP BY field, canonical""",
}
