"""Queries over the crawl tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.functions import urls
from sitelake.operators import graph, html, ngrams, reports, search
from sitelake.sources.tables import read_spread
from sitelake.sources.tables import read_table as table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# scans
@query("SELECT id, url FROM pages WHERE content IS NOT NULL AND content <> '' AND status_code = 200")
def scan_pages_ok(spark, root):
    return table(spark, root, "pages").where("content IS NOT NULL AND content <> '' AND status_code = 200").select("id", "url")


@query("SELECT id, source_url, target_url FROM links WHERE is_external = 0")
def links_internal(spark, root):
    return table(spark, root, "links").where("is_external = 0").select("id", "source_url", "target_url")


@query("SELECT id, source_url, target_url FROM links WHERE is_external = 1")
def links_external(spark, root):
    return table(spark, root, "links").where("is_external = 1").select("id", "source_url", "target_url")


@query("SELECT id, name, start_url, sitemap_url FROM project WHERE run_mode = 'discovery' OR sitemap_url IS NOT NULL")
def project_scan(spark, root):
    return table(spark, root, "project").where("run_mode = 'discovery' OR sitemap_url IS NOT NULL").select("id", "name", "start_url", "sitemap_url")


@query("SELECT url, arg_max(status_code, id) AS status_code FROM (SELECT * FROM requests WHERE url IS NOT NULL AND status_code IS NOT NULL) GROUP BY url")
def status_last_per_url(spark, root):
    return table(spark, root, "requests").where("url IS NOT NULL AND status_code IS NOT NULL").groupBy("url").agg(F.max_by("status_code", "id").alias("status_code"))


@query("SELECT id, coalesce(TRY_CAST(status_code AS INT), 0) AS status_code, coalesce(content_type, '') AS content_type, TRY_CAST(url AS DOUBLE) AS as_number FROM pages")
def typed_columns(spark, root):
    t = table(spark, root, "pages")
    return t.select("id", F.coalesce("status_code", F.lit(0)).alias("status_code"), F.coalesce("content_type", F.lit("")).alias("content_type"), F.col("url").try_cast("double").alias("as_number"))


# the predicate language
def _search(name: str, text: str, sql: str, columns: str = "id") -> None:
    def run(spark, root):
        return search.search(text, lambda t: table(spark, root, t), columns.split())

    QUERIES[name], SQL[name] = run, sql


_search("query_eq_ci", "pages.content_type = 'TEXT/HTML'", "SELECT id FROM pages WHERE lower(content_type) = 'text/html'")
_search("query_ne_null", "pages.content_type != 'text/html'", "SELECT id FROM pages WHERE lower(content_type) <> 'text/html'")
_search("query_numeric_cmp", "requests.status_code >= 400", "SELECT id, status_code FROM requests WHERE status_code >= 400", "id status_code")
_search("query_text_number", "pages.status_code != 'abc'", "SELECT id FROM pages WHERE status_code <> TRY_CAST('abc' AS DOUBLE)")
_search("query_like", "pages.url LIKE '%/EN/%'", "SELECT id FROM pages WHERE lower(url) LIKE '%/en/%'")
_search("query_contains", "pages.url CONTAINS 'Shop_'", "SELECT id FROM pages WHERE lower(url) LIKE '%shop_%'")
_search("query_not", "NOT pages.url CONTAINS 'shop'", "SELECT id FROM pages WHERE NOT lower(url) LIKE '%shop%'")
_search(
    "query_and_or_precedence", "pages.status_code = 404 OR pages.status_code = 500 AND pages.url CONTAINS 'de'",
    "SELECT id FROM pages WHERE status_code = 404 OR (status_code = 500 AND lower(url) LIKE '%de%')",
)
_search("query_quoted_and", "pages.content CONTAINS 'and the' AND pages.status_code = 200", "SELECT id FROM pages WHERE lower(content) LIKE '%and the%' AND status_code = 200")
_search("query_output_cols", "audits.severity = 'critical'", "SELECT id, page_id, issue_code FROM audit_issues WHERE lower(severity) = 'critical'", "id page_id issue_code")
_search("query_external_scope", "external_links.target_url CONTAINS 'badge'", "SELECT id FROM links WHERE is_external = 1 AND lower(target_url) LIKE '%badge%'")


@query("SELECT count(*) AS n FROM requests WHERE status_code >= 400")
def query_result_count(spark, root):
    return search.search("requests.status_code >= 400", lambda t: table(spark, root, t)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM links) AS links")
def query_row_count(spark, root):
    pages = table(spark, root, "pages").agg(F.count(F.lit(1)).alias("pages"))
    return pages.join(F.broadcast(table(spark, root, "links").agg(F.count(F.lit(1)).alias("links"))))  # a row each


# joins and reports
_PARTS = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)'"
_SEGMENTS = (
    f"list_filter(string_split(url_decode(regexp_replace(regexp_extract(url, {_PARTS}, 3), '^/+|/+$', '', 'g')) || "
    r"CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) ELSE '' END, '/'), lambda x: x <> '')"
)
_SEV = "CASE WHEN upper(trim(severity)) IN ('INFO', 'WARNING', 'CRITICAL') THEN upper(trim(severity)) ELSE 'INFO' END"
_RANK = f"CASE {_SEV} WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END"


@query("SELECT i.id, p.url, p.status_code, i.issue_code FROM audit_issues i JOIN pages p ON i.page_id = p.id")
def issue_page_join(spark, root):
    pages = table(spark, root, "pages", "id", "url", "status_code").withColumnRenamed("id", "page_id")
    return table(spark, root, "audit_issues", "id", "page_id", "issue_code").join(pages, "page_id").select("id", "url", "status_code", "issue_code")


@query("SELECT i.id, coalesce(p.status_code, 0) AS status_code, i.issue_code FROM audit_issues i LEFT JOIN pages p ON i.page_id = p.id")
def issue_page_left_join(spark, root):
    pages = table(spark, root, "pages", "id", "status_code").withColumnRenamed("id", "page_id")
    return table(spark, root, "audit_issues", "id", "page_id", "issue_code").join(pages, "page_id", "left").select("id", F.coalesce("status_code", F.lit(0)).alias("status_code"), "issue_code")


@query(f"SELECT i.id, p.url, i.category, i.issue_code, {_SEV} AS severity, {_RANK} AS severity_rank, i.message FROM audit_issues i LEFT JOIN pages p ON i.page_id = p.id")
def action_list(spark, root):
    pages = table(spark, root, "pages", "id", "url").withColumnRenamed("id", "page_id")
    issues = table(spark, root, "audit_issues", "id", "page_id", "category", "issue_code", "severity", "message")
    rows = issues.join(pages, "page_id", "left").select("id", "url", "category", "issue_code", reports.severity().alias("severity"), reports.severity_rank().alias("severity_rank"), "message")
    return rows.orderBy(F.desc("severity_rank"), "category", "id")


_METRICS = r"""
    SELECT p.id AS page_id, p.url,
      CASE WHEN regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') = '' THEN 0
           ELSE len(regexp_split_to_array(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\s+')) END AS word_count,
      coalesce(s.internal_links, 0) AS internal_links, coalesce(s.external_links, 0) AS external_links,
      coalesce(g.incoming_links, 0) AS incoming_links, round(r.server_time, 6) AS server_time
    FROM pages p
    LEFT JOIN (SELECT source_url, count(*) FILTER (is_external = 0) AS internal_links, count(*) FILTER (is_external = 1) AS external_links FROM links GROUP BY source_url) s ON p.url = s.source_url
    LEFT JOIN (SELECT target_url, count(*) AS incoming_links FROM links WHERE is_external = 0 GROUP BY target_url) g ON p.url = g.target_url
    LEFT JOIN (SELECT url, CASE WHEN NOT isnan(elapsed_time) AND elapsed_time >= 0 THEN elapsed_time END AS server_time FROM requests WHERE status_code = 200 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1) r ON p.url = r.url"""


@query(_METRICS)
def page_metrics(spark, root):
    links = table(spark, root, "links", "source_url", "target_url", "is_external")
    return reports.page_metrics(table(spark, root, "pages", "id", "url", "content"), links, table(spark, root, "requests", "id", "url", "status_code", "elapsed_time"))


@query("SELECT url, CASE WHEN NOT isnan(elapsed_time) AND elapsed_time >= 0 THEN elapsed_time END AS server_time FROM requests WHERE status_code = 200 AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1")
def server_time_first(spark, root):
    return reports.first_ok_request(table(spark, root, "requests", "id", "url", "status_code", "elapsed_time"))


_SEVERITIES = f"""
    SELECT p.id AS page_id, p.url, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(total, 0) AS total
    FROM pages p LEFT JOIN (SELECT page_id, count(*) FILTER ({_SEV} = 'CRITICAL') AS critical, count(*) FILTER ({_SEV} = 'WARNING') AS warning,
      count(*) FILTER ({_SEV} = 'INFO') AS info, count(*) AS total FROM audit_issues GROUP BY page_id) i ON p.id = i.page_id"""


def _severities(spark, root):
    return reports.page_severities(table(spark, root, "pages", "id", "url"), table(spark, root, "audit_issues", "page_id", "severity"))


@query(_SEVERITIES)
def page_severity_counts(spark, root):
    return _severities(spark, root)


@query(f"SELECT m.*, critical, warning, info, total FROM ({_METRICS}) m JOIN ({_SEVERITIES}) s ON m.page_id = s.page_id")
def page_overview(spark, root):
    """The flagship: each page's metrics beside its issues by severity, the most critical first."""
    return page_metrics(spark, root).join(_severities(spark, root).drop("url"), "page_id").orderBy(F.desc("critical"), "page_id")


@query(f"SELECT category, issue_code, CASE max({_RANK}) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n FROM audit_issues GROUP BY category, issue_code")
def issue_tree(spark, root):
    return reports.issue_tree(table(spark, root, "audit_issues", "category", "issue_code", "severity"))


@query("SELECT category, issue_code, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY category), 2) AS percent FROM audit_issues GROUP BY category, issue_code")
def category_share(spark, root):
    return reports.category_share(table(spark, root, "audit_issues", "category", "issue_code"))


@query(f"SELECT {_SEV} AS severity, category, element_type, issue_code, count(*) AS n FROM audit_issues WHERE issue_code IS NOT NULL GROUP BY ALL")
def management_summary(spark, root):
    rows = table(spark, root, "audit_issues").where("issue_code IS NOT NULL").groupBy(reports.severity().alias("severity"), "category", "element_type", "issue_code")
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT category, issue_code, count(*) AS total_issues, count(DISTINCT page_id) AS pages_with_issues FROM audit_issues GROUP BY ROLLUP (category, issue_code)")
def audit_summary(spark, root):
    return table(spark, root, "audit_issues").rollup("category", "issue_code").agg(F.count(F.lit(1)).alias("total_issues"), F.countDistinct("page_id").alias("pages_with_issues"))


@query("SELECT DISTINCT issue_code FROM audit_issues WHERE issue_code IS NOT NULL")
def distinct_codes(spark, root):
    return table(spark, root, "audit_issues").where("issue_code IS NOT NULL").select("issue_code").distinct()


@query("SELECT issue_code FROM audit_issues WHERE issue_code IS NOT NULL UNION SELECT unnest(['MISSING_H1', 'EMPTY_H1', 'MISSING_ROOT'])")
def codes_union(spark, root):
    declared = spark.createDataFrame([("MISSING_H1",), ("EMPTY_H1",), ("MISSING_ROOT",)], "issue_code string")
    return distinct_codes(spark, root).union(declared).distinct().orderBy("issue_code")


@query("SELECT id, issue_code FROM audit_issues WHERE issue_code NOT IN ('MISSING_ALT', 'URL_UPPERCASE') AND NOT contains(message, 'near shop')")
def hidden_filter(spark, root):
    rows = table(spark, root, "audit_issues").where(~F.col("issue_code").isin("MISSING_ALT", "URL_UPPERCASE"))
    return html.without_ignored(rows, ["near shop"]).select("id", "issue_code")


@query(
    f"""WITH s AS ({_SEVERITIES}),
    p AS (SELECT *, {_SEGMENTS} AS seg FROM s WHERE url IS NOT NULL),
    e AS (SELECT unnest(list_transform(range(len(seg) + 1), lambda i: '/' || array_to_string(seg[1:i], '/'))) AS prefix, critical, warning, info FROM p)
    SELECT prefix, count(*) AS pages, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(warning) AS BIGINT) AS warning, CAST(sum(info) AS BIGINT) AS info FROM e GROUP BY prefix"""
)
def site_tree_rollup(spark, root):
    return reports.site_tree(_severities(spark, root))


@query("SELECT status_code, count(*) AS n FROM requests GROUP BY status_code")
def status_distribution(spark, root):
    return table(spark, root, "requests").groupBy("status_code").agg(F.count(F.lit(1)).alias("n")).orderBy("status_code")


@query(
    """WITH r AS (SELECT count(*) AS total_requests, greatest(1.0, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6) AS s FROM requests),
    p AS (SELECT count(*) AS total_pages, round(avg(strlen(content)) / 1024, 4) AS mean_kb FROM pages)
    SELECT total_requests, total_pages, round(CAST(s AS DOUBLE), 3) AS seconds, round(total_pages / s, 6) AS pages_per_second, mean_kb FROM r, p"""
)
def crawl_kpis(spark, root):
    return reports.crawl_kpis(table(spark, root, "pages", "content"), table(spark, root, "requests", "created_at"))


@query("SELECT count(*) AS n_pages, round(avg(length(content)) / 1024, 2) AS mean_size FROM pages")
def project_stats(spark, root):
    return table(spark, root, "pages", "content").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg(F.length("content")) / 1024, 2).alias("mean_size"))


_VALID = "elapsed_time IS NOT NULL AND NOT isnan(elapsed_time) AND elapsed_time >= 0"


@query(
    f"""SELECT project_id, count(*) AS sent, count(t) AS n, round(100 * (count(*) - count(t)) / count(*), 4) AS loss_percent, round(min(t), 6) AS least, round(avg(t), 6) AS mean,
    round(median(t), 6) AS median, round(quantile_cont(t, 0.95), 6) AS p95, round(max(t), 6) AS most, round(stddev_samp(t), 6) AS jitter
    FROM (SELECT project_id, CASE WHEN {_VALID} THEN elapsed_time END AS t FROM requests) GROUP BY project_id HAVING count(t) > 0"""
)
def latency_stats(spark, root):
    return reports.latency_stats(table(spark, root, "requests", "project_id", "elapsed_time"))


@query(
    """WITH c AS (SELECT project_id, source_url, count(*) AS n FROM links GROUP BY ALL), m AS (SELECT project_id, median(n) AS med FROM c GROUP BY project_id),
    d AS (SELECT c.project_id, any_value(med) AS med, median(abs(n - med)) AS mad FROM c JOIN m USING (project_id) GROUP BY c.project_id)
    SELECT project_id, CAST(CASE WHEN mad = 0 THEN ceil(2.5 * med) ELSE ceil(med + 3 * 1.4826 * mad + 2) END AS BIGINT) AS threshold FROM d"""
)
def mad_threshold(spark, root):
    counts = table(spark, root, "links", "project_id", "source_url").where("project_id IS NOT NULL").groupBy("project_id", "source_url").agg(F.count(F.lit(1)).alias("n"))
    return reports.outlier_threshold(counts, "project_id", "n")


@query(f"SELECT id, CASE WHEN elapsed_time < 0.2 THEN 'NORMAL' WHEN elapsed_time < 0.5 THEN 'ELEVATED' ELSE 'HIGH' END AS level, CASE WHEN status_code >= 400 THEN 'red' WHEN status_code >= 300 THEN 'orange' ELSE 'green' END AS colour FROM requests WHERE {_VALID}")
def threshold_classify(spark, root):
    t, s = F.col("elapsed_time"), F.col("status_code")
    level = F.when(t < 0.2, "NORMAL").when(t < 0.5, "ELEVATED").otherwise("HIGH")
    colour = F.when(s >= 400, "red").when(s >= 300, "orange").otherwise("green")
    return table(spark, root, "requests").where(_VALID).select("id", level.alias("level"), colour.alias("colour"))


@query("SELECT max(id) AS id, url FROM requests WHERE url IS NOT NULL GROUP BY url")
def dedup_keep_last(spark, root):
    return reports.keep_last(table(spark, root, "requests", "id", "url").where("url IS NOT NULL"), "url", "id").select("id", "url")


@query("SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT url FROM requests) WHERE url IS NOT NULL")
def append_dedup(spark, root):
    return table(spark, root, "pages", "url").unionAll(table(spark, root, "requests", "url")).where("url IS NOT NULL").dropDuplicates(["url"])


# URLs
_HOST = f"lower(regexp_extract({{}}, {_PARTS}, 2))"


@query(rf"SELECT id, {_HOST.format('target_url')} AS host, regexp_replace(target_url, '#.*$', '') AS no_fragment, regexp_replace(target_url, '[?#].*$', '') AS no_query, regexp_replace(target_url, '/+$', '') AS no_slash FROM links")
def url_normalize(spark, root):
    u = F.col("target_url")
    return table(spark, root, "links", "id", "target_url").select("id", urls.host(u).alias("host"), urls.without_fragment(u).alias("no_fragment"), urls.without_query(u).alias("no_query"), urls.without_end_slash(u).alias("no_slash"))


@query(f"SELECT id, array_to_string({_SEGMENTS}, '|') AS segments FROM pages")
def url_segments(spark, root):
    return table(spark, root, "pages", "id", "url").select("id", F.array_join(urls.segments(F.col("url")), "|").alias("segments"))


@query(rf"SELECT id, lower(regexp_extract(regexp_extract(target_url, {_PARTS}, 3), '[^/.](\.[^./]*)$', 1)) AS extension FROM links WHERE target_url IS NOT NULL")
def url_extensions(spark, root):
    return table(spark, root, "links", "id", "target_url").where("target_url IS NOT NULL").select("id", urls.extension(F.col("target_url")).alias("extension"))


_BARE = r"regexp_replace(" + _HOST + r", '^www\.', '')"


@query(
    f"""SELECT id, CASE WHEN b = '' OR a = b THEN 'same' WHEN ends_with(b, '.' || a) THEN 'subdomain' ELSE 'external' END AS kind FROM
    (SELECT id, {_BARE.format('source_url')} AS a, {_BARE.format('target_url')} AS b FROM links WHERE source_url IS NOT NULL AND target_url IS NOT NULL)"""
)
def link_classification(spark, root):
    rows = table(spark, root, "links", "id", "source_url", "target_url").where("source_url IS NOT NULL AND target_url IS NOT NULL")
    return rows.select("id", urls.link_kind(F.col("source_url"), F.col("target_url")).alias("kind"))


@query(f"SELECT {_BARE.format('target_url')} AS host, count(*) AS n, CASE WHEN count(*) > 50 THEN 2 ELSE 5 END AS parallel FROM links WHERE is_external = 1 AND target_url IS NOT NULL GROUP BY 1")
def domain_counts(spark, root):
    rows = table(spark, root, "links", "target_url", "is_external").where("is_external = 1 AND target_url IS NOT NULL")
    counts = rows.groupBy(urls.bare_host(F.col("target_url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("parallel", F.when(F.col("n") > 50, 2).otherwise(5))


# texts
_WORDS = r"list_filter(regexp_split_to_array(lower(body_text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9à-öø-ÿ]+'))"
_STOP = ", ".join(f"'{w}'" for w in ngrams.STOP_WORDS)


def _texts(spark, root):
    return read_spread(spark, root, "htmldocument", "page_id", "body_text").toDF("id", "text")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM htmldocument) GROUP BY word")
def tokens(spark, root):
    return _texts(spark, root).select(F.explode(ngrams.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _ngrams(name: str, n: int) -> None:
    def run(spark, root):
        return ngrams.top_ngrams(_texts(spark, root), n).withColumnRenamed("id", "page_id")

    QUERIES[name] = run
    SQL[name] = f"""
      WITH t AS (SELECT page_id, list_filter({_WORDS}, lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS w FROM htmldocument WHERE body_text IS NOT NULL),
      g AS (SELECT page_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram, unnest(range(1, len(w) - {n - 2})) AS pos FROM t WHERE len(w) >= {n}),
      c AS (SELECT page_id, gram, count(*) AS n_times, min(pos) AS first FROM g GROUP BY page_id, gram),
      r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n_times DESC, first, gram) AS place FROM c)
      SELECT page_id, gram, n_times, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n_times DESC, first, gram) AS rank FROM r
        WHERE place <= 60 AND regexp_matches(gram, '\\p{{L}}')) WHERE rank <= 20"""


_ngrams("unigrams_top", 1)
_ngrams("bigrams_top", 2)
_ngrams("trigrams_top", 3)

# graph
_EDGES = "SELECT DISTINCT regexp_replace(source_url, '/+$', '') AS src, regexp_replace(target_url, '/+$', '') AS dst FROM links WHERE is_external = 0 AND source_url IS NOT NULL AND target_url IS NOT NULL"
_ROUNDS = 4


def _edges(spark, root):
    return graph.edges_of(table(spark, root, "links", "source_url", "target_url", "is_external"))


def _ranks_sql(select: str) -> str:
    steps = [
        f"""r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} JOIN v USING (node) WHERE d IS NULL) / n + 0.85 * coalesce(got, 0) AS rank
        FROM v CROSS JOIN c LEFT JOIN (SELECT e.dst AS node, sum(rank / d) AS got FROM e JOIN v ON e.src = v.node JOIN r{i} ON r{i}.node = v.node GROUP BY e.dst) g ON g.node = v.node)"""
        for i in range(_ROUNDS)
    ]
    return f"""WITH e AS MATERIALIZED ({_EDGES}), d AS (SELECT src AS node, count(*) AS d FROM e GROUP BY src),
      v AS MATERIALIZED (SELECT node, d FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN d USING (node)), c AS (SELECT count(*) AS n FROM v),
      r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, c), {", ".join(steps)} {select}"""


@query(_ranks_sql(f"SELECT node, round(rank, 9) AS rank FROM r{_ROUNDS}"))
def pagerank_fixed(spark, root):
    return graph.pagerank(_edges(spark, root), rounds=_ROUNDS, tolerance=None).select("node", F.round("rank", 9).alias("rank"))


@query(_ranks_sql(f"SELECT node, round((ln(rank) - min(ln(rank)) OVER ()) / (max(ln(rank)) OVER () - min(ln(rank)) OVER ()) * 10, 3) AS score FROM r{_ROUNDS}"))
def pagerank_log_scale(spark, root):
    return graph.log_scaled(graph.pagerank(_edges(spark, root), rounds=_ROUNDS, tolerance=None), digits=3)


def pagerank_converged(spark, root):
    return graph.pagerank(_edges(spark, root))


QUERIES["pagerank_converged"] = pagerank_converged


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES}),
    l AS (SELECT regexp_replace(url, '/+$', '') AS node, arg_max(status_code, id) AS status FROM pages WHERE url IS NOT NULL GROUP BY 1
      UNION ALL SELECT regexp_replace(url, '/+$', ''), arg_max(status_code, id) FROM requests WHERE url IS NOT NULL GROUP BY 1),
    s AS (SELECT node, max(status) AS status FROM l WHERE status > 0 GROUP BY node),
    r AS (SELECT node, status FROM s UNION SELECT e.dst, r.status FROM r JOIN e ON e.src = r.node)
    SELECT node, CAST(max(status) AS INT) AS status FROM r GROUP BY node"""
)
def status_propagation(spark, root):
    seeds = graph.status_seeds(table(spark, root, "pages", "id", "url", "status_code"), table(spark, root, "requests", "id", "url", "status_code"))
    return graph.propagate_status(_edges(spark, root), seeds)


_DEPTH = 5  # of the SQL; the query has no bound, so rows of deeper nodes are only in the query


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES}),
    r AS (SELECT DISTINCT regexp_replace(start_url, '/+$', '') AS node, 0 AS level FROM project WHERE start_url IS NOT NULL
      UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE r.level < {_DEPTH})
    SELECT node, min(level) AS level FROM r GROUP BY node"""
)
def bfs_levels(spark, root):
    starts = table(spark, root, "project", "start_url").select(urls.without_end_slash(F.col("start_url")).alias("node"))
    return graph.levels(_edges(spark, root), starts)


# HTML: tested on fixtures, as SQL has no parser
def _facts(spark, root):
    return html.parse_pages(read_spread(spark, root, "pages", "id", "url", "content"))


@query()
def html_elements(spark, root):
    return html.elements(_facts(spark, root))


@query()
def html_links(spark, root):
    return html.anchors(_facts(spark, root))


@query()
def html_images(spark, root):
    return html.images(_facts(spark, root))


@query()
def html_page_types(spark, root):
    return _facts(spark, root).select("page_id", html.page_type().alias("page_type"), html.is_product().alias("is_product"))


@query()
def audit_issues_found(spark, root):
    return html.issues(_facts(spark, root), table(spark, root, "requests", "id", "url", "status_code"))


@query()
def email_extract(spark, root):
    return html.emails(_facts(spark, root))


@query()
def email_domain_scope(spark, root):
    return html.email_scope(html.emails(_facts(spark, root)), table(spark, root, "pages", "id", "url"))
