"""More queries over the crawl tables: ordered reports, logs, links, typed rows and HTML in stored form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake.catalog import Crawl, aligned
from sitelake.functions import urls
from sitelake.operators import graph, history, html, ngrams, redirects, nested, reports
from sitelake.plans import crawl
from sitelake.plans.crawl import _HOST, _PARTS, _SEV, _VALID
from sitelake.sources import sinks
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


# ordered and limited forms
@query("SELECT id, url, status_code FROM pages ORDER BY id LIMIT 10")
def display_head(spark, root):
    """What a console shows of a table: its first ten rows."""
    return table(spark, root, "pages", "id", "url", "status_code").orderBy("id").limit(10)


@query("SELECT id, url FROM pages WHERE content IS NOT NULL AND content <> '' AND status_code = 200 ORDER BY id LIMIT 100")
def max_pages(spark, root):
    """The pages of a run that is to take no more than a hundred."""
    return crawl.scan_pages_ok(spark, root).orderBy("id").limit(100)


@query("SELECT i.issue_code, p.url, i.message FROM audit_issues i JOIN pages p ON i.page_id = p.id WHERE i.issue_code IS NOT NULL")
def issue_urls(spark, root):
    """Each code's pages, in the order of their URLs."""
    pages = table(spark, root, "pages", "id", "url").withColumnsRenamed({"id": "page_id", "url": "page_url"})
    rows = table(spark, root, "audit_issues", "page_id", "issue_code", "message").where("issue_code IS NOT NULL").join(pages, "page_id")
    return rows.select("issue_code", F.col("page_url").alias("url"), "message").orderBy("url", "issue_code")


@query("SELECT category, issue_code, count(*) AS n FROM audit_issues GROUP BY category, issue_code")
def issue_tree_ordered(spark, root):
    return table(spark, root, "audit_issues", "category", "issue_code").groupBy("category", "issue_code").agg(F.count(F.lit(1)).alias("n")).orderBy("category", "issue_code")


@query("SELECT category, issue_code, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, issue_code NULLS FIRST) AS INT) AS place FROM (SELECT category, issue_code, count(*) AS n FROM audit_issues GROUP BY category, issue_code)")
def most_common_codes(spark, root):
    """The codes of each category, the most frequent first."""
    from pyspark.sql import Window as W

    order = W.partitionBy("category").orderBy(F.desc("n"), F.asc_nulls_first("issue_code"))
    return issue_tree_ordered(spark, root).withColumn("place", F.row_number().over(order))


@query("SELECT page_id, gram, n_times, rank FROM (" + crawl.SQL["unigrams_top"] + ") WHERE rank <= 10")
def unigrams_top10(spark, root):
    return crawl.QUERIES["unigrams_top"](spark, root).where("rank <= 10")


@query(
    f"""WITH p AS (SELECT DISTINCT unnest(list_transform(range(len(s) + 1), lambda i: s[1:i])) AS way FROM (SELECT {crawl._SEGMENTS} AS s FROM pages WHERE url IS NOT NULL))
    SELECT '/' || array_to_string(way[1:len(way) - 1], '/') AS prefix, array_to_string(list_sort(list(way[len(way)])), '|') AS children FROM p WHERE len(way) > 0 GROUP BY 1"""
)
def tree_children(spark, root):
    """The names below each path, sorted."""
    s = urls.segments(F.col("url"))
    ways = table(spark, root, "pages", "url").where("url IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.slice(s, 1, i))).alias("way")).distinct()
    named = ways.where(F.size("way") > 0).select(F.concat(F.lit("/"), F.array_join(F.slice("way", F.lit(1), F.size("way") - 1), "/")).alias("prefix"), F.element_at("way", -1).alias("name"))
    return named.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("children"))


# requests as a log
@query("SELECT max(id) AS id, url FROM requests GROUP BY url")
def log_last_occurrences(spark, root):
    return history.last_occurrences(table(spark, root, "requests", "id", "url"), "id", "url").select("id", "url").orderBy("id")


@query("SELECT id, url FROM (SELECT max(id) AS id, url FROM requests WHERE url IS NOT NULL GROUP BY url) ORDER BY id DESC LIMIT 20")
def log_recent(spark, root):
    return history.recent(table(spark, root, "requests", "id", "url").where("url IS NOT NULL"), "id", "url", 20).select("id", "url")


@query("SELECT id, url FROM requests WHERE id NOT IN (SELECT id FROM requests ORDER BY id LIMIT 5) AND id NOT IN (SELECT id FROM requests ORDER BY id DESC LIMIT 7)")
def log_without_ends(spark, root):
    return history.without_ends(table(spark, root, "requests", "id", "url"), "id", 5, 7).select("id", "url")


@query("SELECT count(url) AS total, count(DISTINCT url) AS different, count(url) - count(DISTINCT url) AS duplicates FROM requests")
def log_duplicate_stats(spark, root):
    return history.duplicate_stats(table(spark, root, "requests", "url"), "url")


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (status_code BETWEEN 200 AND 399) AS success, count(*) FILTER (NOT coalesce(status_code BETWEEN 200 AND 399, false)) AS errors,
    round(1000 * avg(CASE WHEN {_VALID} THEN elapsed_time END), 4) AS mean_ms,
    round(count(*) / greatest(1.0, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6), 6) AS per_second FROM requests"""
)
def benchmark_totals(spark, root):
    r = table(spark, root, "requests", "status_code", "elapsed_time", "created_at")
    fine = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    span = (F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 1e6
    return r.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(fine).alias("success"), F.count_if(~fine).alias("errors"), F.round(1000 * F.avg(F.when(F.expr(_VALID), F.col("elapsed_time"))), 4).alias("mean_ms"),
        F.round(F.count(F.lit(1)) / F.greatest(F.lit(1.0), span), 6).alias("per_second"),
    )


@query(
    """SELECT p.id AS project_id, coalesce(r.n, 0) AS total_requests, round(CASE WHEN p.total_time > 0 THEN p.total_time ELSE greatest(1.0, coalesce(r.span, 0)) END, 3) AS seconds,
    round(coalesce(r.n, 0) / (CASE WHEN p.total_time > 0 THEN p.total_time ELSE greatest(1.0, coalesce(r.span, 0)) END), 6) AS per_second
    FROM project p LEFT JOIN (SELECT project_id, count(*) AS n, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 AS span FROM requests GROUP BY project_id) r ON p.id = r.project_id"""
)
def project_kpis(spark, root):
    """Requests and seconds of each project; its own total_time, where it has one, takes the place of the time between its requests."""
    span = (F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 1e6
    r = table(spark, root, "requests", "project_id", "created_at").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), span.alias("span"))
    p = table(spark, root, "project", "id", "total_time").withColumnRenamed("id", "project_id").join(r, "project_id", "left")
    seconds = F.when(F.col("total_time") > 0, F.col("total_time")).otherwise(F.greatest(F.lit(1.0), F.coalesce("span", F.lit(0.0))))
    n = F.coalesce("n", F.lit(0))
    return p.select("project_id", n.alias("total_requests"), F.round(seconds, 3).alias("seconds"), F.round(n / seconds, 6).alias("per_second"))


@query("SELECT count(*) AS pages, count(*) FILTER (content IS NOT NULL AND content <> '' AND status_code = 200) AS eligible, (SELECT count(DISTINCT page_id) FROM htmldocument WHERE page_id IN (SELECT id FROM pages)) AS parsed FROM pages")
def parse_stats(spark, root):
    pages = table(spark, root, "pages", "id", "content", "status_code")
    done = table(spark, root, "htmldocument", "page_id").distinct().join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi").agg(F.count(F.lit(1)).alias("parsed"))
    fine = F.coalesce(F.expr("content <> '' AND status_code = 200"), F.lit(False))
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(fine).alias("eligible")).join(F.broadcast(done))  # a row each


@query(
    f"""SELECT project_id, CASE max(CASE WHEN NOT ({_VALID}) OR elapsed_time IS NULL OR status_code < 0 THEN 4 WHEN elapsed_time < 0.2 THEN 1 WHEN elapsed_time < 0.5 THEN 2 ELSE 3 END)
    WHEN 4 THEN 'ERROR' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'ELEVATED' ELSE 'NORMAL' END AS worst FROM requests GROUP BY project_id"""
)
def project_worst_level(spark, root):
    """The worst level of each project's requests; ERROR where a request has no valid time or failed on our side."""
    t = F.col("elapsed_time")
    rank = F.when(~F.coalesce(F.expr(_VALID), F.lit(False)) | (F.col("status_code") < 0), 4).when(t < 0.2, 1).when(t < 0.5, 2).otherwise(3)
    worst = F.element_at(F.array(*map(F.lit, ("NORMAL", "ELEVATED", "HIGH", "ERROR"))), F.max(rank))
    return table(spark, root, "requests", "project_id", "elapsed_time", "status_code").groupBy("project_id").agg(worst.alias("worst"))


_OUTCOMES = {-1: "client error", -2: "internal error", -10: "unsupported type", -99: "unknown error"}  # fixed values: status codes of fetches that had no answer


@query(
    "SELECT outcome, count(*) AS n FROM (SELECT CASE status_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _OUTCOMES.items()) + """ ELSE
    CASE WHEN status_code IS NULL OR status_code <= 0 THEN 'no answer' WHEN status_code >= 400 THEN 'failed' WHEN status_code >= 300 THEN 'redirected' ELSE 'answered' END END AS outcome FROM requests) GROUP BY outcome"""
)
def fetch_outcomes(spark, root):
    """Requests by how they ended, with the codes that stand for fetches without an answer."""
    code = F.col("status_code")
    known = F.when(code.isNull() | (code <= 0), "no answer").when(code >= 400, "failed").when(code >= 300, "redirected").otherwise("answered")
    for value, name in _OUTCOMES.items():
        known = F.when(code == value, name).otherwise(known)
    return table(spark, root, "requests", "status_code").groupBy(known.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# predicates and typed rows
@query("SELECT id, element_type FROM audit_issues WHERE element_type IN ('image', 'anchor', 'h1')")
def issues_of_elements(spark, root):
    return table(spark, root, "audit_issues", "id", "element_type").where(F.col("element_type").isin("image", "anchor", "h1"))


@query("SELECT id, url FROM pages WHERE regexp_matches(url, '/(en|de|nl)/.*[0-9]', 'i')")
def url_regex_filter(spark, root):
    return table(spark, root, "pages", "id", "url").where(F.coalesce(F.col("url").rlike("(?i)/(en|de|nl)/.*[0-9]"), F.lit(False)))


@query("SELECT id, target_url FROM links WHERE is_external = 1 AND starts_with(target_url, 'http') AND coalesce(status_code, 0) = 0")
def unchecked_links(spark, root):
    rows = table(spark, root, "links", "id", "target_url", "is_external", "status_code")
    return rows.where((F.col("is_external") == 1) & F.startswith("target_url", F.lit("http")) & (F.coalesce("status_code", F.lit(0)) == 0)).select("id", "target_url")


@query(
    """SELECT id, coalesce(TRY_CAST(project_id AS INT), 0) AS project_id, coalesce(url, '') AS url, coalesce(status_code, 0) AS status_code, CASE WHEN NOT isnan(elapsed_time) THEN elapsed_time END AS elapsed_time,
    '' AS content_type, CAST(0 AS BIGINT) AS size FROM requests"""
)
def aligned_rows(spark, root):
    """Requests in the columns and types of another table, with defaults for what they lack."""
    schema = T.StructType().add("id", "long").add("project_id", "integer").add("url", "string").add("status_code", "integer").add("elapsed_time", "double").add("content_type", "string").add("size", "long")
    return aligned(table(spark, root, "requests"), schema)


@query("SELECT id, CASE WHEN regexp_full_match(anchor, '[0-9]{1,9}') THEN CAST(anchor AS INT) END AS number, regexp_replace(anchor, '\\s+', ' ', 'g') AS collapsed, array_to_string(list_filter(regexp_split_to_array(rel, '\\s+'), lambda x: x <> ''), ' ') AS rel FROM links")
def anchor_texts(spark, root):
    """Anchors as numbers where they are nothing else, with single blanks, and the words of rel."""
    a = F.col("anchor")
    number = F.when(a.rlike("^[0-9]{1,9}$"), a).try_cast("int")
    rel = F.array_join(F.filter(F.split("rel", r"\s+"), lambda x: x != ""), " ")
    return table(spark, root, "links", "id", "anchor", "rel").select("id", number.alias("number"), F.regexp_replace(a, r"\s+", " ").alias("collapsed"), rel.alias("rel"))


@query(
    """SELECT issue_code, CASE WHEN contains(issue_code, 'MISSING') OR contains(issue_code, 'BROKEN') THEN 'CRITICAL' WHEN contains(issue_code, 'EMPTY') OR contains(issue_code, 'TOO') THEN 'WARNING' ELSE 'INFO' END AS severity,
    count(*) AS n FROM audit_issues WHERE issue_code IS NOT NULL GROUP BY issue_code"""
)
def severity_guesses(spark, root):
    """A severity for each code by its words alone."""
    c = F.col("issue_code")
    guess = F.when(c.contains("MISSING") | c.contains("BROKEN"), "CRITICAL").when(c.contains("EMPTY") | c.contains("TOO"), "WARNING").otherwise("INFO")
    return table(spark, root, "audit_issues", "issue_code").where("issue_code IS NOT NULL").groupBy("issue_code", guess.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, TRY_CAST(CASE WHEN id % 2 = 0 THEN CAST(created_at AS VARCHAR) ELSE content_type END AS TIMESTAMP) AS at FROM pages")
def parsed_times(spark, root):
    """Text as a time, null where it is none: the time of even ids, the content type of odd ones."""
    text = F.when(F.col("id") % 2 == 0, F.col("crawled_at").cast("string")).otherwise(F.col("content_type"))
    return table(spark, root, "pages", "id", "crawled_at", "content_type").select("id", F.expr("1").alias("x"), text.alias("t")).select("id", F.col("t").try_cast("timestamp_ntz").alias("at"))


SQL["parsed_times"] = SQL["parsed_times"].replace("created_at", "crawled_at")


@query("SELECT table_name, column_name, CAST(ordinal_position AS INT) AS position FROM information_schema.columns WHERE table_name IN ('pages', 'requests', 'project', 'links', 'audit_issues') ")
def schema_columns(spark, root):
    found = Crawl(spark, root).schemas()
    return found.where(~F.col("table_name").isin("internal_links", "external_links")).select("table_name", "column_name", "position")


@query("SELECT DISTINCT issue_code FROM audit_issues WHERE issue_code IS NOT NULL AND issue_code NOT IN ('MISSING_ALT', 'URL_UPPERCASE')")
def codes_visible(spark, root):
    """All codes, declared or found, but the hidden ones; declared ones that are never found are left to the rule catalogue."""
    hidden = spark.createDataFrame([("MISSING_ALT",), ("URL_UPPERCASE",)], "issue_code string")
    return crawl.distinct_codes(spark, root).join(F.broadcast(hidden), "issue_code", "left_anti").orderBy("issue_code")


# links
_FLAG_HOST = _HOST.format("{}")


@query(
    f"""SELECT id, CASE WHEN hs = ht AND page AND NOT contains(target_url, '?') AND NOT contains(target_url, '#') THEN 0 WHEN page AND hs <> ht THEN 1 END AS flag FROM (
      SELECT id, target_url, {_HOST.format('source_url')} AS hs, {_HOST.format('target_url')} AS ht,
        lower(regexp_extract(target_url, {_PARTS}, 1)) IN ('http', 'https') AND {_HOST.format('target_url')} <> '' AND
        lower(regexp_extract(regexp_extract(target_url, {_PARTS}, 3), '[^/.](\\.[^./]*)$', 1)) IN ({", ".join(f"'{x}'" for x in urls.PAGE_EXTENSIONS)}) AS page
      FROM links WHERE source_url IS NOT NULL AND target_url IS NOT NULL)"""
)
def link_flags(spark, root):
    rows = table(spark, root, "links", "id", "source_url", "target_url").where("source_url IS NOT NULL AND target_url IS NOT NULL")
    return rows.select("id", urls.link_flag(F.col("source_url"), F.col("target_url")).alias("flag"))


_BARE_URL = r"regexp_replace(regexp_replace({}, '[?#].*$', ''), ';[^/]*$', '')"


@query(f"SELECT id, {_BARE_URL.format('target_url')} AS bare FROM links")
def url_without_params(spark, root):
    return table(spark, root, "links", "id", "target_url").select("id", urls.without_params(F.col("target_url")).alias("bare"))


@query(
    f"""WITH u AS (SELECT DISTINCT target_url FROM links WHERE target_url IS NOT NULL),
    s AS (SELECT {_BARE_URL.format('url')} AS bare, arg_max(status_code, id) AS status_code FROM requests WHERE url IS NOT NULL AND status_code IS NOT NULL GROUP BY 1)
    SELECT target_url, status_code FROM u JOIN s ON {_BARE_URL.format('target_url')} = s.bare"""
)
def status_of_variants(spark, root):
    """The last status of a bare URL, for each link target that is a variant of it."""
    bare = lambda c: urls.without_params(F.col(c)).alias("bare")
    variants = table(spark, root, "links", "target_url").where("target_url IS NOT NULL").distinct().select("target_url", bare("target_url"))
    last = table(spark, root, "requests", "id", "url", "status_code").where("url IS NOT NULL AND status_code IS NOT NULL").groupBy(bare("url")).agg(F.max_by("status_code", "id").alias("status_code"))
    return variants.join(last, "bare").select("target_url", "status_code")


@query(
    crawl._ranks_sql(
        f"""SELECT p.id AS page_id, round((ln(rank) - lo) / (hi - lo) * 10, 3) AS score FROM pages p JOIN r{crawl._ROUNDS} r ON regexp_replace(p.url, '/+$', '') = r.node,
        (SELECT min(ln(rank)) AS lo, max(ln(rank)) AS hi FROM r{crawl._ROUNDS})"""
    )
)
def pagerank_pages(spark, root):
    """The score of each page whose URL, with or without end slashes, is a node."""
    scores = graph.log_scaled(graph.pagerank(crawl._edges(spark, root), rounds=crawl._ROUNDS, tolerance=None), digits=3)
    pages = table(spark, root, "pages", "id", "url").select(F.col("id").alias("page_id"), urls.without_end_slash(F.col("url")).alias("node"))
    return pages.join(scores, "node").select("page_id", "score")


@query()
def redirect_ends(spark, root):
    """Where each redirect of the stored chains ends."""
    chains = nested.flatten_nested(table(spark, root, "requests", "id", "redirect_chain"), "id", {"redirect_chain": "redirect_chain"}, "objects").where("shape = '*'")
    hops = chains.select(F.col("record_id").alias("id"), "position", F.col("members")["source"].alias("source"), F.col("members")["target"].alias("target"))
    last = redirects.last_targets(hops)
    return redirects.walk(last.select(F.col("source").alias("url")), last)


# exports
@query(
    """SELECT column_name, CAST(least(max(len) + 2, 100) AS INT) AS width FROM (
      SELECT unnest(['id', 'category', 'issue_code', 'severity', 'message']) AS column_name,
        unnest([length(CAST(id AS VARCHAR)), length(category), length(issue_code), length(severity), length(message)]) AS len FROM audit_issues
      UNION ALL SELECT unnest(['id', 'category', 'issue_code', 'severity', 'message']), unnest([2, 8, 10, 8, 7])) GROUP BY column_name"""
)
def sheet_widths(spark, root):
    return sinks.column_widths(table(spark, root, "audit_issues", "id", "category", "issue_code", "severity", "message"))


# texts
@query("SELECT page_id, gram, CAST(n_times AS INT) AS n_times FROM (" + crawl.SQL["unigrams_top"] + ")")
def ngrams_read_back(spark, root):
    """The n-grams of each page from their stored JSON."""
    stored = ngrams.stored(crawl.QUERIES["unigrams_top"](spark, root).withColumnRenamed("page_id", "id"))
    return ngrams.read_stored(stored).withColumnRenamed("id", "page_id")


# HTML: tested on fixtures, as SQL has no parser
@query()
def page_report(spark, root):
    """The fifteen metrics of each page."""
    links = table(spark, root, "links", "source_url", "target_url", "is_external")
    requests = table(spark, root, "requests", "id", "url", "status_code", "elapsed_time")
    return reports.page_report(table(spark, root, "pages", "id", "url", "content"), links, requests, html.page_facts(crawl._facts(spark, root)))


@query()
def stored_elements(spark, root):
    return html.stored_elements(crawl._facts(spark, root))


@query()
def element_pivot(spark, root):
    return html.element_pivot(stored_elements(spark, root), table(spark, root, "pages", "id"))


@query()
def images_distinct(spark, root):
    return Crawl(spark, root).images()


@query()
def pages_with_types(spark, root):
    """Every page with its type, unknown where its text names none."""
    types = crawl._facts(spark, root).select("page_id", html.page_type().alias("page_type"))
    return table(spark, root, "pages", "id", "url").withColumnRenamed("id", "page_id").join(types, "page_id", "left").select("page_id", "url", F.coalesce("page_type", F.lit("unknown")).alias("page_type"))


@query()
def structured_items(spark, root):
    """(page_id, item, type): each object of the pages' structured data."""
    rows = crawl._facts(spark, root).select("page_id", F.explode("ld_items").alias("item"))
    return rows.withColumn("type", F.get_json_object("item", "$['@type']"))


@query()
def emails_of_site(spark, root):
    """The different e-mail addresses of all pages."""
    return html.emails(crawl._facts(spark, root)).select("email").distinct()


@query()
def product_pages(spark, root):
    return html.filtered(crawl._facts(spark, root), "any_product").select("page_id", "url")
