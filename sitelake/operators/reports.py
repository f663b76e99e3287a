"""Metrics and reports over pages, links, requests and audit issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelake.functions import urls

#: Severities by rank.
SEVERITIES = ("INFO", "WARNING", "CRITICAL")


def severity(column: str = "severity") -> Column:
    """The severity in capitals, INFO where it is null or unknown."""
    up = F.upper(F.trim(column))
    return F.when(up.isin(*SEVERITIES), up).otherwise("INFO")


def severity_rank() -> Column:
    return F.when(severity() == "CRITICAL", 3).when(severity() == "WARNING", 2).otherwise(1)


def counts_by_url(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, internal, external) by source and (url, incoming) by target; rows count, not distinct links."""
    out = links.where("source_url IS NOT NULL").groupBy(F.col("source_url").alias("url"))
    sent = out.agg(F.count_if(F.col("is_external") == 0).alias("internal_links"), F.count_if(F.col("is_external") == 1).alias("external_links"))
    got = links.where("target_url IS NOT NULL AND is_external = 0").groupBy(F.col("target_url").alias("url")).agg(F.count(F.lit(1)).alias("incoming_links"))
    return sent, got


def word_count(text: str) -> Column:
    """Words between white space of the stored text, 0 for null and blank."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def first_ok_request(requests: DataFrame) -> DataFrame:
    """(url, server_time): elapsed_time of the first request of each URL with status 200; null where it is NaN or negative, hence no time."""
    first = requests.where("status_code = 200 AND url IS NOT NULL").groupBy("url").agg(F.min_by(F.struct("elapsed_time"), "id")["elapsed_time"].alias("server_time"))
    return first.withColumn("server_time", F.when(~F.isnan("server_time") & (F.col("server_time") >= 0), F.col("server_time")))


def page_metrics(pages: DataFrame, links: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a page: link counts, words and the time of its first successful request; 0 and null where there is none."""
    sent, got = counts_by_url(links)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        pages.select(F.col("id").alias("page_id"), "url", word_count("content").alias("word_count"))
        .join(sent, "url", "left")
        .join(got, "url", "left")
        .join(first_ok_request(requests), "url", "left")
        .select("page_id", "url", "word_count", zero("internal_links"), zero("external_links"), zero("incoming_links"), F.round("server_time", 6).alias("server_time"))
    )


def page_report(pages: DataFrame, links: DataFrame, requests: DataFrame, facts: DataFrame) -> DataFrame:
    """page_metrics with what facts (page_facts) says of each page: lengths, images, canonical. broken_img_ratio is null, as no table tells which images are broken."""
    counts = ("title_length", "meta_desc_length", "h1_length", "total_images", "missing_alt_tags", "has_canonical")
    both = page_metrics(pages, links, requests).join(facts, "page_id", "left")
    return both.select(
        "page_id", "url", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("missing_alt_ratio", F.lit(0.0)).alias("missing_alt_ratio"),
        "internal_links", "external_links", "incoming_links", "word_count", "server_time", F.lit(None).cast("double").alias("broken_img_ratio"),
    )


def page_severities(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(page_id, url, critical, warning, info, total) for every page."""
    per = issues.where("page_id IS NOT NULL").groupBy("page_id").agg(*[F.count_if(severity() == s).alias(s.lower()) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "warning", "info", "total")]
    return pages.select(F.col("id").alias("page_id"), "url").join(per, "page_id", "left").select("page_id", "url", *zero)


def site_tree(severities: DataFrame) -> DataFrame:
    """(prefix, pages, critical, warning, info): sums over all pages below each path, hosts ignored; '/' is the root."""
    parts = urls.segments(F.col("url"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    rows = severities.where("url IS NOT NULL").select(F.explode(prefixes).alias("prefix"), "critical", "warning", "info")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("critical", "warning", "info")])


def issue_tree(issues: DataFrame) -> DataFrame:
    """(category, issue_code, severity, n): issues of each code with its greatest severity."""
    names = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank()))
    return issues.groupBy("category", "issue_code").agg(names.alias("severity"), F.count(F.lit(1)).alias("n"))


def category_share(issues: DataFrame) -> DataFrame:
    """(category, issue_code, n, percent): each code's share of its category."""
    counts = issues.groupBy("category", "issue_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("category")), 2))


def crawl_kpis(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: requests, pages, seconds between the first and last request (1 at least), pages a second, mean KB of content."""
    r = requests.agg(F.count(F.lit(1)).alias("total_requests"), (F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))).alias("span"))
    p = pages.agg(F.count(F.lit(1)).alias("total_pages"), F.round(F.avg(F.octet_length("content")) / 1024, 4).alias("mean_kb"))
    seconds = F.greatest(F.lit(1.0), F.coalesce(F.col("span"), F.lit(0)) / 1e6)
    both = r.join(F.broadcast(p))  # a row each
    return both.select("total_requests", "total_pages", F.round(seconds, 3).alias("seconds"), F.round(F.col("total_pages") / seconds, 6).alias("pages_per_second"), "mean_kb")


def exact_quantiles(counts: DataFrame, key: str, value: str, n: str, at: dict[str, float]) -> DataFrame:
    """(key, a column for each name of `at`): quantiles of (key, value, n), interpolated between neighbours.

    Different values are added up in their order, so that a key needs no buffer of its values.
    """
    rows = counts.groupBy(key, value).agg(F.sum(n).alias("__n"))
    order = W.partitionBy(key).orderBy(value)
    total = rows.groupBy(key).agg(F.sum("__n").alias("__total"))
    run = rows.withColumn("__upto", F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).join(total, key)
    position = {name: F.lit(p) * (F.col("__total") - 1) for name, p in at.items()}
    rank = lambda r: F.min(F.when(F.col("__upto") > r, F.col(value).cast("double")))
    ends = [(rank(F.floor(x)).alias(f"__{i}_low"), rank(F.ceil(x)).alias(f"__{i}_high"), F.first(x - F.floor(x)).alias(f"__{i}_part")) for i, x in enumerate(position.values())]
    found = run.groupBy(key).agg(*[c for three in ends for c in three])
    between = lambda i: F.col(f"__{i}_low") + (F.col(f"__{i}_high") - F.col(f"__{i}_low")) * F.col(f"__{i}_part")
    return found.select(key, *[between(i).alias(name) for i, name in enumerate(at)])


def latency_stats(requests: DataFrame) -> DataFrame:
    """(project_id, sent, n, loss_percent, least, mean, median, p95, most, jitter): all requests, and of those with a valid time its statistics. Projects without one have none."""
    t = "elapsed_time"
    valid = F.col(t).isNotNull() & ~F.isnan(t) & (F.col(t) >= 0)
    ok = requests.where(valid)
    r = lambda c, name: F.round(c, 6).alias(name)
    time = F.when(valid, F.col(t))
    sums = requests.groupBy("project_id").agg(F.count(F.lit(1)).alias("sent"), F.count(time).alias("n"), r(F.min(time), "least"), r(F.avg(time), "mean"), r(F.max(time), "most"), r(F.stddev_samp(time), "jitter"))
    counts = ok.groupBy("project_id", t).agg(F.count(F.lit(1)).alias("n"))
    middle = exact_quantiles(counts, "project_id", t, "n", {"median": 0.5, "p95": 0.95}).withColumnRenamed("project_id", "p")
    both = sums.where("n > 0").join(middle, F.col("project_id").eqNullSafe(F.col("p")))
    return both.select("project_id", "sent", "n", F.round(100 * (F.col("sent") - F.col("n")) / F.col("sent"), 4).alias("loss_percent"), "least", "mean", r(F.col("median"), "median"), r(F.col("p95"), "p95"), "most", "jitter")


def outlier_threshold(counts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold): ceil(median + 3 * 1.4826 * MAD + 2), or ceil(2.5 * median) where the MAD is 0. Null keys and values are left out."""
    sizes = counts.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__count"))
    med = exact_quantiles(sizes, key, value, "__count", {"med": 0.5})
    apart = sizes.join(med, key).select(key, F.abs(F.col(value) - F.col("med")).alias("apart"), "__count")
    mad = exact_quantiles(apart, key, "apart", "__count", {"mad": 0.5}).join(med, key)
    rule = F.when(F.col("mad") == 0, F.ceil(2.5 * F.col("med"))).otherwise(F.ceil(F.col("med") + 3 * 1.4826 * F.col("mad") + 2))
    return mad.select(key, rule.alias("threshold"))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest `order` of each key, as one aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
