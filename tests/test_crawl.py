import glob
import math
import os
from itertools import product
from urllib.parse import urljoin

import duckdb
import pytest

from sitelake import plans
from sitelake.functions import urls
from sitelake.operators import components, graph, html, ngrams, reports, search
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"


def test_query_language(spark):
    pages = spark.createDataFrame([(1, "http://a/FR/x", 404, "it's"), (2, "http://a/de", 500, "a\\b"), (3, None, None, "this and that")], "id long, url string, status_code int, content string")
    run = lambda q: sorted(r["id"] for r in search.search(q, lambda t: pages).collect())
    assert run("pages.url CONTAINS 'fr'") == [1]
    assert run("NOT pages.url CONTAINS 'fr'") == [2]
    assert run("pages.status_code = 404 OR pages.status_code = 500 AND pages.url CONTAINS 'zz'") == [1]
    assert run("pages.status_code != 'abc'") == []
    assert run("pages.content CONTAINS 'this and that'") == [3]
    assert run("pages.content LIKE 'a\\b%'") == [2]
    assert run('pages.content = "it\'s"') == [1]
    assert run("pages.content CONTAINS \"it's\"") == [1]
    for bad in ("nosuch.url = 'x'", "pages.url = 'x' AND requests.url = 'y'", "pages.url ~ 'x'", "pages.nosuch = 1", "pages.url =", ""):
        with pytest.raises(search.QueryError):
            run(bad)


PAGE = """<!DOCTYPE html><html><head><title>Short</title><meta name="description" content=""><link rel="alternate canonical" href="">
<script type="application/ld+json">{"@type": "Product"}</script></head><body class="x"><h1></h1><h1><img src="a.png"></h1>
<a href="">e</a><a href="/Up_per//x y">u</a><a href="https://other.test/A_B">o</a><a href="mailto:Info@site.test?subject=x">m</a><a href="#f">f</a>
<img alt="  " src="data:image/png;base64,%s"><img><p>Mail jan [at] site [dot] test &amp; go</body></html>""" % ("A" * 21000)


def facts(spark, *texts):
    df = spark.createDataFrame([(i, "https://www.site.test/dir/p", t) for i, t in enumerate(texts)], "id long, url string, content string")
    return html.parse_pages(df)


def test_rules(spark):
    found = {r["issue_code"] for r in html.issues(facts(spark, PAGE)).collect()}
    assert {"TITLE_TOO_SHORT", "EMPTY_META_DESC", "EMPTY_CANONICAL", "MISSING_CHARSET", "MISSING_VIEWPORT", "EMPTY_H1", "EMPTY_HREF", "URL_UPPERCASE", "URL_UNDERSCORE", "URL_DOUBLE_SLASH",
            "URL_SPACE", "EMPTY_ALT", "LARGE_BASE64_IMG", "MISSING_ALT", "MISSING_SRC"} <= found
    assert not {"MISSING_TITLE", "MISSING_H1", "MISSING"} & found
    counts = [r["issue_code"] for r in html.issues(facts(spark, PAGE)).collect()]
    assert counts.count("EMPTY_H1") == 1 and counts.count("URL_UPPERCASE") == 1
    bare = {r["issue_code"] for r in html.issues(facts(spark, "<body><p>x"), strict=True).collect()}
    assert bare == {"MISSING_H1", "MISSING", "MISSING_ROOT"}
    assert facts(spark, None, "").count() == 0


def test_elements_links_and_types(spark):
    row = html.elements(facts(spark, "<title>A &amp; <b>B</title><meta property='og:type' content='x'><meta property='og:type' content='y'><h1>One <i>two</i></h1><h2>Z")).first()
    assert row["h1"] == "One two" and row["open_graph"] == '{"og:type":"y"}' and row["headings"] == ["h1 One two", "h2 Z"]
    links = {r["target_url"]: r["is_external"] for r in html.anchors(facts(spark, PAGE)).collect()}
    assert links["https://other.test/A_B"] == 1 and links["https://www.site.test/Up_per//x y"] == 0
    assert {r["email"] for r in html.emails(facts(spark, PAGE)).collect()} == {"info@site.test", "jan@site.test"}
    assert facts(spark, PAGE).select(html.page_type().alias("t"), html.is_product().alias("p")).first()[:] == ("product", True)


def test_joined_like_urljoin(spark):
    bases = ["https://s.test/dir/p", "https://s.test/dir/", "https://s.test", "https://s.test/", "https://s.test/a/b/c?x=1#f", "HTTP://S.test/a//b/./c", "s.test/x/y"]
    refs = [
        "x.html", "../x", "./x", "../../x", "../../../x", "..", ".", "/x", "/a/../b/./c", "//o.test/x", "//o.test", "?q=1", "#f", "x?y#z", "x?", "x#", "https://o.test/A_B", "https:rel",
        "http://o.test/../x", "mailto:a@b.c", "a//b", "/a//b", "/Up_per//x y", "", ";p", "x;p", "../", "./", "a/b/../../../../c", "1:2", "a/./b/", "?", "/..", "ftp://x/y",
    ]
    df = spark.createDataFrame(list(product(bases, refs)), "b string, r string")
    got = df.select("b", "r", urls.joined(F.col("b"), F.col("r")).alias("u")).collect()
    assert [r["u"] for r in got] == [urljoin(r["b"], r["r"]) for r in got]


def test_links_by_last_status_and_relative_references(spark):
    text = "<body><h1>x</h1><a href='../gone'>a</a><a href='late#x'>b</a><a href='fine'>c</a>"
    rows = [(1, "https://www.site.test/gone", 200), (2, "https://www.site.test/gone", 404), (3, "https://www.site.test/dir/late", 500), (4, "https://www.site.test/dir/fine", 500), (5, "https://www.site.test/dir/fine", 200), (6, None, 404)]
    found = html.issues(facts(spark, text), spark.createDataFrame(rows, "id long, url string, status_code int")).collect()
    assert sorted(r["issue_code"] for r in found) == ["BROKEN_LINK", "HTTP_ERROR"]


def test_times_that_are_none(spark):
    rows = [(1, "a", 200, float("nan")), (2, "a", 200, 1.0), (3, "b", 200, -1.0), (4, "c", 200, None), (5, "c", 200, 2.0), (6, "d", 404, 1.0), (7, "d", 200, 3.0)]
    df = spark.createDataFrame(rows, "id long, url string, status_code int, elapsed_time double")
    assert {r["url"]: r["server_time"] for r in reports.first_ok_request(df).collect()} == {"a": None, "b": None, "c": None, "d": 3.0}


def test_ranks_that_do_not_settle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")], "src string, dst string")
    with pytest.raises(graph.NotConverged):
        graph.pagerank(edges, rounds=1, tolerance=1e-12)


def test_graph_fixture(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("b", "d"), ("x", "y")], "src string, dst string")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert math.isclose(sum(ranks.values()), 1, rel_tol=1e-6) and ranks["c"] > ranks["x"]
    seeds = spark.createDataFrame([("a", 404), ("x", 200)], "node string, status int")
    assert {tuple(r) for r in graph.propagate_status(edges, seeds).collect()} == {("a", 404), ("b", 404), ("d", 404), ("x", 200), ("y", 200)}
    assert {tuple(r) for r in graph.levels(edges, seeds.select("node"), 3).collect()} == {("a", 0), ("x", 0), ("b", 1), ("y", 1), ("d", 2)}


def test_hubs_are_spread(spark, monkeypatch):
    edges = spark.createDataFrame([("h", f"n{i}") for i in range(9)] + [(f"n{i}", "h") for i in range(4)] + [("n1", "n2")], "src string, dst string")
    seeds = spark.createDataFrame([("h", 404), ("n8", 200)], "node string, status int")
    found = lambda: ({r["node"]: round(r["rank"], 9) for r in graph.pagerank(edges, rounds=3, tolerance=None).collect()}, {tuple(r) for r in graph.propagate_status(edges, seeds).collect()})
    plain = found()
    monkeypatch.setattr(graph, "HUB", 5)
    assert graph._hubs(edges) is not None and found() == plain


def test_status_travels_any_distance(spark, monkeypatch):
    # rows kept in memory: a checkpoint a round would take minutes
    monkeypatch.setattr(graph, "materialise", lambda df: spark.createDataFrame(df.collect(), df.schema))
    edges = spark.createDataFrame([(i, i + 1) for i in range(205)], "src int, dst int").coalesce(1)
    seeds = spark.createDataFrame([(0, 404), (150, 200)], "node int, status int")
    assert {tuple(r) for r in graph.propagate_status(edges, seeds).collect()} == {(i, 404) for i in range(206)}


def test_levels_have_no_bound(spark, tmp_path):
    links = [(f"http://s/{i}", f"http://s/{i + 1}/", 0) for i in range(9)] + [("http://s/9", "http://s/0", 0), ("http://t/0", "http://t/1", 0)]
    spark.createDataFrame(links, "source_url string, target_url string, is_external int").write.parquet(str(tmp_path / "links.parquet"))
    spark.createDataFrame([("http://s/0/",), (None,)], "start_url string").write.parquet(str(tmp_path / "project.parquet"))
    got = {tuple(r) for r in plans.queries()["bfs_levels"](spark, str(tmp_path)).collect()}
    assert got == {(f"http://s/{i}", i) for i in range(10)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (50, None), (200, 200)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 200: 200}


def test_ngrams_and_urls(spark):
    texts = spark.createDataFrame([(1, "The red fox the red dog 12 34 a_b café"), (2, None), (3, "")], "id long, text string")
    assert [(r["gram"], r["n_times"]) for r in ngrams.top_ngrams(texts, 1).orderBy("rank").collect()] == [("red", 2), ("fox", 1), ("dog", 1), ("café", 1)]
    row = spark.range(1).select(
        urls.segments(F.lit("http://h/a%20b//c+d?x#y")).alias("s"), urls.extension(F.lit("http://h/.hid/a.PHP?x")).alias("e"), urls.is_valid_link(F.lit("https://h/a.pdf")).alias("v"),
        urls.link_kind(F.lit("http://www.a.b/"), F.lit("http://x.a.b/")).alias("k"), urls.base(F.lit("h.x/y")).alias("b"),
    ).first()
    assert (row["s"], row["e"], row["v"], row["k"], row["b"]) == (["a b", "c+d?x"], ".php", False, "subdomain", "http://h.x")


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")
@pytest.mark.parametrize("name", ["page_overview", "site_tree_rollup", "bigrams_top", "status_propagation", "query_and_or_precedence", "p1_link_counts"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cursor = con.execute(plans.sql()[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    want = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    got = plans.queries()[name](spark, ROOT)
    assert sorted(got.columns) == names
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want
