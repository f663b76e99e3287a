import glob
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake import catalog, pipeline, plans
from sitelake.functions import urls
from sitelake.operators import history, html, ngrams, redirects, reports
from sitelake.sources import settings, sinks

ROOT = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title> A <b>title</b></title><meta name="description" content="About"><link rel="canonical" href="https://s.test/a"><meta property="og:title" content="x">
<script type="application/ld+json">[{"@type": "Product", "n": 1}, {"@type": "Brand"}]</script><script type="application/ld+json">{broken</script><script>function addToCart() {}</script></head>
<body><h1>One</h1><h2>Two</h2><h2>Three</h2><img src="a.png" alt="x"><img data-src="../b.png" width="10px"><img srcset="/c.png 2x, d.png"><img src="data:image/gif;base64,R0lGODlhAQABAxyz"><img alt="">
<a href="mailto:Info@s.test">m</a> write to jan [at] s [dot] test<a href="/b?x=1">b</a><a href="/c">c</a></body></html>"""


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("crawl"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    write("project", [(1, "one", "https://s.test/", None, None), (2, "two", "https://t.test/", None, 5.0)], "id long, name string, start_url string, sitemap_url string, total_time double")
    write("pages", [(1, "https://s.test/dir/a", 200, PAGE), (2, "https://s.test/b", 404, None), (3, "https://s.test/c", 200, "")], "id long, url string, status_code int, content string")
    write("links", [(1, 1, "https://s.test/dir/a", "https://s.test/b", 0), (2, 2, "https://t.test/", "https://s.test/b", 1)], "id long, project_id long, source_url string, target_url string, is_external int")
    write("requests", [(1, 1, "https://s.test/dir/a", 200, 0.5), (2, 1, "https://s.test/b", 404, None)], "id long, project_id long, url string, status_code int, elapsed_time double")
    write("audit_issues", [(1, 1, 1, "MISSING_ALT"), (2, 1, 2, None)], "id long, project_id long, page_id long, issue_code string")
    return folder


def test_crawl_tables(spark, root):
    crawl = catalog.Crawl(spark, root, project_id=1)
    assert crawl.table("internal_links").count() == 1 and crawl.table("external_links").count() == 0 and crawl.table("pages").count() == 3
    assert crawl.project(2)["name"] == "two" and crawl.project(9) is None and crawl.page(2)["status_code"] == 404 and crawl.issues_of(1).count() == 1
    assert crawl.query("SELECT count(*) AS n FROM requests WHERE status_code >= :least", least=400).first()["n"] == 1
    assert crawl.query_or_nothing("SELECT nosuch FROM pages").count() == 0
    columns = {(r["table_name"], r["column_name"]) for r in crawl.schemas().collect()}
    assert ("links", "is_external") in columns and ("internal_links", "is_external") not in columns and ("internal_links", "target_url") in columns


def test_stored_elements_and_images(spark, root):
    crawl = catalog.Crawl(spark, root)
    stored = {r["element_type"]: r["content"] for r in crawl.elements().collect()}
    assert stored["page_title"] == "Atitle" and json.loads(stored["headings"]) == {"h1": ["One"], "h2": ["Two", "Three"]} and "robots_meta" not in stored
    assert json.loads(stored["open_graph_tags"]) == {"og:title": "x"} and len(json.loads(stored["structured_data"])) == 2
    assert crawl.elements(["page_title"], [1]).count() == 1 and crawl.elements(page_ids=[2]).count() == 0 and crawl.elements([]).count() == 0
    values = {r["element_type"]: r["v"] for r in crawl.elements(decode=True).select("element_type", F.to_json("value").alias("v")).collect()}
    assert json.loads(values["page_title"]) == "Atitle" and json.loads(values["headings"])["h1"] == ["One"]
    wide = {r["page_id"]: r for r in html.element_pivot(crawl.elements(), crawl.table("pages")).collect()}
    assert wide[1]["canonical_tag"] == "https://s.test/a" and wide[2]["page_title"] is None and len(wide) == 3
    images = {(r["image_url"], r["alt_text"], r["width"]) for r in crawl.images().collect()}
    assert images == {("https://s.test/dir/a.png", "x", None), ("https://s.test/b.png", None, 10), ("https://s.test/c.png", None, None)}
    items = crawl.facts().select(F.explode("ld_items").alias("i")).collect()
    assert [json.loads(r["i"])["@type"] for r in items] == ["Product", "Brand"]
    assert html.filtered(crawl.facts(), "product", "any_product").count() == 1 and {r["email"] for r in html.emails(crawl.facts()).collect()} == {"info@s.test", "jan@s.test"}


def test_page_report(spark, root):
    row = {r["page_id"]: r for r in plans.queries()["page_report"](spark, root).collect()}
    a, b = row[1], row[2]
    assert (a["title_length"], a["meta_desc_length"], a["h1_length"], a["total_images"], a["missing_alt_tags"], a["missing_alt_ratio"], a["has_canonical"]) == (6, 5, 3, 3, 2, 66.67, 1)
    assert (a["internal_links"], a["server_time"], a["broken_img_ratio"]) == (1, 0.5, None) and len(a) == 15
    assert (b["title_length"], b["total_images"], b["missing_alt_ratio"], b["has_canonical"], b["incoming_links"], b["word_count"]) == (0, 0, 0.0, 0, 1, 0)
    assert {r["page_type"] for r in plans.queries()["pages_with_types"](spark, root).collect()} == {"product", "unknown"}


def test_rules_are_declared(spark, root):
    codes = [r["issue_code"] for r in html.rule_catalogue(spark).collect()]
    assert len(codes) == len(set(codes)) == 30
    own = html.Rule("NO_FOOTER", "footer", "INFO", "OWN", "page", lambda x: ~F.col("body_text").contains("footer"))
    found = html.issues(catalog.Crawl(spark, root).facts(), rules=[own])
    assert [(r["page_id"], r["issue_code"], r["message"]) for r in found.collect()] == [(1, "NO_FOOTER", "No footer")]


def test_saved_tables(spark, tmp_path):
    crawl = catalog.Crawl(spark, str(tmp_path), project_id=7)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}.parquet").collect())
    assert crawl.save_result(rows, "x") == "plugin_x" and read("plugin_x") == [(1, "a", 7), (2, "b", 7)]
    crawl.save(rows, "t", "replace")
    crawl.save(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), "t", "ignore", ["k"], "v")
    assert read("t") == [(1, "a"), (2, "b"), (3, "c")]
    crawl.save(spark.createDataFrame([(2, "z")], "k int, v string"), "t", "update", ["k"], "v")
    assert read("t") == [(1, "a"), (2, "z"), (3, "c")]
    crawl.save(rows, "t")
    assert len(read("t")) == 5
    shown = catalog.shown(rows.orderBy("k"), 1)
    assert shown == "k  v\n1  a" and json.loads(catalog.shown(rows.orderBy("k"), 1, as_json=True)) == {"k": 1, "v": "a"}
    sinks.write_sheets({"s": rows}, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book/widths")).count() == 2
    schema = T.StructType().add("v", "string").add("k", "long").add("d", "double").add("new", "string")
    odd = spark.createDataFrame([("7", float("nan")), ("x", 1.5), (None, None)], "k string, d double")
    assert [tuple(r) for r in catalog.aligned(odd, schema).collect()] == [("", 7, None, ""), ("", 0, 1.5, ""), ("", 0, None, "")]


def test_history(spark, tmp_path):
    text = "\n".join(f"\n# 2024-05-0{i} 10:00:00\n+{c}" for i, c in enumerate(["command1", "two\n+lines", "command1", "other"], 1)) + "\n\n# no time\n+last\n\n# 2024-05-09 10:00:00\n"
    (tmp_path / "h").write_text(text)
    log = history.read_history(spark, str(tmp_path / "h"))
    rows = [(r["command"], str(r["at"])) for r in log.orderBy("position").collect()]
    assert [c for c, _ in rows] == ["command1", "two\nlines", "command1", "other", "last"] and rows[0][1] == "2024-05-01 10:00:00" and rows[4][1] == "None"
    commands = lambda df: [r["command"] for r in df.orderBy("position").collect()]
    assert commands(history.last_occurrences(log, "position", "command")) == ["two\nlines", "command1", "other", "last"]
    assert [r["command"] for r in history.recent(log, "position", "command", 2).collect()] == ["last", "other"]
    assert commands(history.without_ends(log, "position", 1, 2)) == ["two\nlines", "command1"]
    assert history.duplicate_stats(log, "command").first()[:] == (5, 4, 1)
    counts = spark.createDataFrame([("a 'b c' d",), ("open ' quote",), ("",), (None,)], "c string").select(history.word_counts()("c").alias("n")).collect()
    assert [r["n"] for r in counts] == [3, 3, 0, None]


def test_pipeline():
    parsed = [(s.name, list(s.args), s.before) for s in pipeline.parse("""a "b c" 'd' && e|f ; g || h x=\"&& y\"""")]
    assert parsed == [("a", ["b c", "d"], None), ("e", [], "&&"), ("f", [], "|"), ("g", [], ";"), ("h", ["x=&& y"], "||")]
    assert pipeline.parse("") == [] and pipeline.parse("a ;") == pipeline.parse("a")
    for bad in ("&& a", "a &&", "a | | b", 'a "b'):
        with pytest.raises(pipeline.SyntaxProblem):
            pipeline.parse(bad)
    ran = []

    def step(code):
        def handler(context, args):
            ran.append((code, args, context.variables["pipe"]))
            context.piped = f"from {code}"
            return code

        return handler

    context = pipeline.Context(pipeline.BASIC | {"ok": step(0), "bad": step(1), "quit": step(pipeline.QUIT)}, {"a": {"b": 5}, "n": "x"})
    assert pipeline.run("ok 1 | ok @{pipe} && bad || ok @{a.b}-@{n}-@{none}", context) == 0
    assert [(c, a) for c, a, _ in ran] == [(0, ["1"]), (0, ["from 0"]), (1, []), (0, ["5-x-@{none}"])]
    ran.clear()
    assert pipeline.run("bad && ok 1 | ok 2 ; ok 3 || ok 4 && quit ; ok 5", context) == pipeline.QUIT
    assert [(c, a) for c, a, _ in ran] == [(1, []), (0, ["3"]), (pipeline.QUIT, [])]
    assert pipeline.run("set name some value && get name", context) == 0 and context.piped == "some value" and pipeline.run("nosuch", context) == 127


def test_settings_and_lists(tmp_path):
    (tmp_path / "s.json").write_text('{"a": {"b": 5, "on": true}, "name": "x"}')
    s = settings.Settings.load(str(tmp_path / "s.json"))
    assert s.get("a.b") == 5 and s.get("a.c", 1) == 1 and s.get("name.x") is None and settings.Settings.load("/nosuch").get("a") is None
    s.set("a.b", "7")
    s.set("a.on", "no")
    s.set("new.deep", [1])
    assert s.get("a.b") == 7 and s.get("a.on") is False and s.get("new.deep") == [1]
    with pytest.raises(ValueError):
        s.set("a.b", "seven")
    names = settings.NameList(str(tmp_path / "hidden.json"))
    names.add(["B", "A"])
    names.add(["A"])
    assert names.names() == ["A", "B"]
    names.reset()
    assert names.names() == []
    flows = settings.Workflows(str(tmp_path / "w.json"))
    flows.save("b", "x  &&\n y")
    flows.save("A", "z")
    assert list(flows.all()) == ["A", "b"] and flows.all()["b"] == "x && y" and flows.remove("A") and not flows.remove("A")


def test_redirects(spark):
    hops = [(1, 0, "a", "b"), (2, 0, "b", "c"), (3, 0, "l", "m"), (4, 0, "m", "l"), (5, 0, "s", "s"), (6, 0, "b", "d"), (7, 0, None, "x"), (8, 0, "x", None)] + [(10 + i, 0, f"n{i}", f"n{i + 1}") for i in range(9)]
    last = redirects.last_targets(spark.createDataFrame(hops, "id long, position int, source string, target string"))
    starts = spark.createDataFrame([("a",), ("l",), ("s",), ("z",), ("n0",), ("n4",), (None,), ("a",)], "url string")
    got = {r["url"]: (r["final_url"], r["hops"], r["outcome"]) for r in redirects.walk(starts, last).collect()}
    assert got == {"a": ("d", 2, "final"), "l": ("l", 2, "loop"), "s": ("s", 1, "loop"), "z": ("z", 0, "final"), "n0": ("n5", 5, "too_many"), "n4": ("n9", 5, "final")}


def test_quantiles_and_urls(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 50, 37)] + [("one", 4.0)]
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: (r["m"], r["q"]) for r in reports.exact_quantiles(counts.where("k is not null"), "k", "v", "n", {"m": 0.5, "q": 0.95}).collect()}
    assert all(np.allclose(got[k], np.quantile([v for x, v in rows if x == k], [0.5, 0.95])) for k in ("a", "b", "one"))
    one = spark.range(1).select(urls.without_params(F.lit("http://h/a;b/c;d?x#y")).alias("p"), urls.segments(F.lit("http://h/a/?q=x/y")).alias("s"), urls.link_flag(F.lit("http://h/"), F.lit("http://h/x?y")).alias("f")).first()
    assert (one["p"], one["s"], one["f"]) == ("http://h/a;b/c", ["a?q=x", "y"], None)
    assert ngrams.stop_list(["The", "of course"], ["a"]) == ["a", "the"]


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")
@pytest.mark.parametrize("name", ["aligned_rows", "anchor_texts", "link_flags", "tree_children", "status_of_variants", "latency_stats", "mad_threshold", "ngrams_read_back", "log_without_ends", "project_kpis"])
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
    assert want and sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want
