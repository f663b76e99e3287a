"""Pages parsed once into typed facts: titles, metadata, headings, images, anchors, structured data.

One Arrow pass turns each page into a row of scalars and arrays; elements, links,
images, rules and page types are columns over that row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import urls

_HEADING = pa.struct([("level", pa.int32()), ("text", pa.string()), ("direct_img", pa.bool_())])
_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("has_doctype", pa.bool_()), ("has_root", pa.bool_()), ("has_head", pa.bool_()), ("has_body", pa.bool_()), ("title", pa.string()),
        ("head_title", pa.string()), ("metas", pa.list_(pa.struct([("in_head", pa.bool_()), ("attrs", pa.map_(pa.string(), pa.string()))]))),
        ("link_tags", pa.list_(pa.struct([("in_head", pa.bool_()), ("attrs", pa.map_(pa.string(), pa.string()))]))), ("headings", pa.list_(_HEADING)),
        ("anchors", pa.list_(pa.struct([("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))),
        ("images", pa.list_(pa.map_(pa.string(), pa.string()))), ("json_ld", pa.list_(pa.string())), ("ld_items", pa.list_(pa.string())), ("scripts", pa.list_(pa.string())), ("body_class", pa.string()), ("body_text", pa.string()),
    ]
)
_DDL = (
    "page_id long, url string, has_doctype boolean, has_root boolean, has_head boolean, has_body boolean, title string, head_title string, "
    "metas array<struct<in_head:boolean,attrs:map<string,string>>>, link_tags array<struct<in_head:boolean,attrs:map<string,string>>>, "
    "headings array<struct<level:int,text:string,direct_img:boolean>>, anchors array<struct<text:string,attrs:map<string,string>>>, "
    "images array<map<string,string>>, json_ld array<string>, ld_items array<string>, scripts array<string>, body_class string, body_text string"
)
#: Fixed value: the one-pixel image that lazy loaders put in place of another.
PIXEL = "data:image/gif;base64,R0lGODlhAQABA"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _items(text: str) -> list[str]:
    """The objects of a JSON-LD text, those of a list one by one; none where it is broken."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return []
    return [json.dumps(x, ensure_ascii=False).encode("utf-8", "replace").decode() for x in (found if isinstance(found, list) else [found])]


class _Page(HTMLParser):
    """Facts of one page; unclosed tags end with the page, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.row = {n: [] for n in ("metas", "link_tags", "headings", "anchors", "images", "json_ld", "ld_items", "scripts")}
        self.row |= {"has_doctype": False, "has_root": False, "has_head": False, "has_body": False, "title": None, "head_title": None, "body_class": None}
        self.stack: list[str] = []
        self.title = self.heading = self.anchor = self.script = None
        self.body: list[str] = []

    def handle_decl(self, decl):
        self.row["has_doctype"] |= decl.lower().startswith("doctype")

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        head = "head" in self.stack
        if tag == "html":
            self.row["has_root"] = True
        elif tag == "head":
            self.row["has_head"] = True
        elif tag == "body":
            self.row["has_body"] = True
            self.row["body_class"] = a.get("class")
            if "head" in self.stack:
                del self.stack[self.stack.index("head") :]
        elif tag == "title" and (self.row["title"] is None or head and self.row["head_title"] is None):
            self.title = ([], head)
        elif tag == "meta":
            self.row["metas"].append({"in_head": head, "attrs": list(a.items())})
        elif tag == "link":
            self.row["link_tags"].append({"in_head": head, "attrs": list(a.items())})
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = [int(tag[1]), [], False, len(self.stack)]
        elif tag == "a":
            self._end_anchor()
            self.anchor = ([], a)
        elif tag == "img":
            self.row["images"].append(list(a.items()))
            if self.heading and len(self.stack) == self.heading[3] + 1:
                self.heading[2] = True
        elif tag == "script":
            self.script, self.is_ld = [], a.get("type", "").lower() == "application/ld+json"
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title" and self.title:
            text = "".join(self.title[0])
            if self.row["title"] is None:
                self.row["title"] = text
            if self.title[1] and self.row["head_title"] is None:
                self.row["head_title"] = text
            self.title = None
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and self.heading:
            self._end_heading()
        elif tag == "a":
            self._end_anchor()
        elif tag == "script" and self.script is not None:
            text = "".join(self.script)
            if text.strip():
                self.row["json_ld" if self.is_ld else "scripts"].append(text)
                if self.is_ld:
                    self.row["ld_items"] += _items(text)
            self.script = None
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def _end_heading(self):
        if self.heading:
            self.row["headings"].append({"level": self.heading[0], "text": " ".join(self.heading[1]), "direct_img": self.heading[2]})
            self.heading = None

    def _end_anchor(self):
        if self.anchor:
            self.row["anchors"].append({"text": "".join(self.anchor[0]), "attrs": list(self.anchor[1].items())})
            self.anchor = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        bare = data.strip()
        if not bare:
            return
        if self.title:
            self.title[0].append(bare)
        if self.heading:
            self.heading[1].append(bare)
        if self.anchor:
            self.anchor[0].append(bare)
        if self.row["has_body"] and self.stack[-1:] not in (["script"], ["style"]):
            self.body.append(bare)

    def end(self) -> dict:
        self.close()
        self._end_heading()
        self._end_anchor()
        if self.title:
            self.handle_endtag("title")
        return self.row | {"body_text": " ".join(self.body)}


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row of facts for each page of (id, url, content) with content; null and empty content has none."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                page = _Page()
                page.feed(text)
                rows.append(page.end() | {"page_id": i, "url": url})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return pages.where("content IS NOT NULL AND content <> ''").select("id", "url", "content").mapInArrow(run, _DDL)


def _meta(key: str, value: str, head: bool = False) -> Column:
    """The first content of a meta tag whose attribute `key` is `value`; null where there is none."""
    hit = F.filter("metas", lambda m: (F.lower(m["attrs"][key]) == value) & (m["in_head"] | F.lit(not head)))
    return F.when(F.size(hit) > 0, F.trim(F.coalesce(F.get(hit, F.lit(0))["attrs"]["content"], F.lit(""))))


def _canonical(head: bool = False) -> Column:
    hit = F.filter("link_tags", lambda m: F.array_contains(F.split(F.lower(m["attrs"]["rel"]), r"\s+"), "canonical") & (m["in_head"] | F.lit(not head)))
    return F.when(F.size(hit) > 0, F.coalesce(F.get(hit, F.lit(0))["attrs"]["href"], F.lit("")))


def _heading_map() -> Column:
    """JSON of level name -> texts, for the levels that a page has."""
    levels = F.array_sort(F.array_distinct(F.transform("headings", lambda h: h["level"])))
    texts = lambda n: F.transform(F.filter("headings", lambda h: h["level"] == n), lambda h: h["text"])
    return F.when(F.size("headings") > 0, F.to_json(F.map_from_arrays(F.transform(levels, lambda n: F.concat(F.lit("h"), n)), F.transform(levels, texts))))


def _open_graph() -> Column:
    graph = F.filter("metas", lambda m: F.startswith(m["attrs"]["property"], F.lit("og:")))
    keys = F.array_distinct(F.transform(graph, lambda m: m["attrs"]["property"]))
    last = lambda k: F.element_at(F.filter(graph, lambda m: m["attrs"]["property"] == k), -1)["attrs"]["content"]
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, last)))


def _first_h1() -> Column:
    return F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]


def elements(facts: DataFrame) -> DataFrame:
    """(page_id, title, meta_description, canonical, robots, h1, headings, open_graph, structured_data); empty text elements are null."""
    return facts.select(
        "page_id",
        F.nullif("title", F.lit("")).alias("title"),
        F.nullif(_meta("name", "description"), F.lit("")).alias("meta_description"),
        F.nullif(_canonical(), F.lit("")).alias("canonical"),
        F.nullif(_meta("name", "robots"), F.lit("")).alias("robots"),
        _first_h1().alias("h1"),
        F.transform("headings", lambda h: F.concat(F.lit("h"), h["level"], F.lit(" "), h["text"])).alias("headings"),
        _open_graph().alias("open_graph"),
        F.col("json_ld").alias("structured_data"),
    )


#: The types of stored elements.
ELEMENT_TYPES = ("page_title", "meta_description", "canonical_tag", "headings", "robots_meta", "open_graph_tags", "structured_data")


def stored_elements(facts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(page_id, element_type, content): a row for each element that a page has, lists and maps as JSON; empty ones are not stored."""
    wanted = ELEMENT_TYPES if types is None else [t for t in ELEMENT_TYPES if t in types]
    made = {
        "page_title": F.col("title"),
        "meta_description": _meta("name", "description"),
        "canonical_tag": _canonical(),
        "headings": _heading_map(),
        "robots_meta": F.when(_meta("name", "robots") != "", F.to_json(F.struct(_meta("name", "robots").alias("content")))),
        "open_graph_tags": F.nullif(_open_graph(), F.lit("{}")),
        "structured_data": F.when(F.size("json_ld") > 0, F.to_json("json_ld")),
    }
    if not wanted:
        return facts.select("page_id", F.lit("").alias("element_type"), F.lit("").alias("content")).limit(0)
    rows = F.array(*[F.struct(F.lit(t).alias("element_type"), made[t].alias("content")) for t in wanted])
    return facts.select("page_id", F.explode(rows).alias("e")).select("page_id", "e.*").where("content <> ''")


def element_pivot(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, a column for each element type): every page of (id), null for what it lacks."""
    wide = stored.groupBy("page_id").pivot("element_type", list(ELEMENT_TYPES)).agg(F.min("content"))
    return pages.select(F.col("id").alias("page_id")).join(wide, "page_id", "left")


def page_facts(facts: DataFrame) -> DataFrame:
    """(page_id, title_length, meta_desc_length, h1_length, total_images, missing_alt_tags, missing_alt_ratio, has_canonical): 0 for what a page lacks."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    shown = F.filter("images", lambda i: _source(i).isNotNull() & ~F.startswith(_source(i), F.lit(PIXEL)))
    row = facts.select(
        "page_id",
        size(F.col("title")).alias("title_length"),
        size(_meta("name", "description")).alias("meta_desc_length"),
        size(_first_h1()).alias("h1_length"),
        F.size(shown).alias("total_images"),
        F.size(F.filter(shown, lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")).alias("missing_alt_tags"),
        F.coalesce((_canonical() != "").cast("int"), F.lit(0)).alias("has_canonical"),
    )
    return row.withColumn("missing_alt_ratio", F.when(F.col("total_images") > 0, F.round(100 * F.col("missing_alt_tags") / F.col("total_images"), 2)).otherwise(F.lit(0.0)))


def anchors(facts: DataFrame) -> DataFrame:
    """(page_id, source_url, target_url, anchor, rel, is_external): the links of each page that can be followed, fragments dropped."""
    href = F.trim("a.attrs.href")
    rows = facts.select("page_id", F.col("url").alias("source_url"), F.explode("anchors").alias("a"))
    kept = rows.where(href.isNotNull() & (href != "") & ~href.rlike(r"(?i)^(?:#|mailto:|tel:|javascript:)"))
    target = urls.without_fragment(urls.joined(F.col("source_url"), href))
    out = kept.select("page_id", "source_url", target.alias("target_url"), F.col("a.text").alias("anchor"), F.col("a.attrs.rel").alias("rel"))
    return out.where(urls.has_page_extension(F.col("target_url"))).withColumn("is_external", (urls.host(F.col("source_url")) != urls.host(F.col("target_url"))).cast("int"))


def _source(image: Column) -> Column:
    """Where an image comes from: src, else data-src, else the first of srcset; null for none."""
    first = F.get(F.split(F.trim(F.get(F.split(image["srcset"], ","), F.lit(0))), r"\s+"), F.lit(0))
    return F.coalesce(F.nullif(F.trim(image["src"]), F.lit("")), F.nullif(F.trim(image["data-src"]), F.lit("")), F.nullif(first, F.lit("")))


def images(facts: DataFrame) -> DataFrame:
    """(page_id, image_url, alt_text, width, height): src, else data-src, else the first of srcset; tracking pixels left out."""
    rows = facts.select("page_id", "url", F.explode("images").alias("i"))
    whole = lambda c: F.regexp_replace(F.col("i")[c], "[^0-9]", "").try_cast("int").alias(c)
    found = rows.withColumn("s", _source(F.col("i"))).where(F.col("s").isNotNull() & ~F.startswith("s", F.lit(PIXEL)))
    return found.select("page_id", urls.joined(F.col("url"), F.col("s")).alias("image_url"), F.trim(F.col("i")["alt"]).alias("alt_text"), whole("width"), whole("height"))


def page_type() -> Column:
    """product, category, article or unknown, by the first type that the structured data names."""
    text = F.array_join("json_ld", "\n")
    named = lambda *types: text.rlike(r'"@type"\s*:\s*"(?:' + "|".join(types) + ')"')
    return F.when(named("Product"), "product").when(named("CollectionPage", "ItemList"), "category").when(named("Article", "BlogPosting", "NewsArticle"), "article").otherwise("unknown")


def is_product() -> Column:
    """Whether any sign names a product: structured data, og:type, a product property or a class of the body."""
    kind, prop = _meta("property", "og:type"), F.exists("metas", lambda m: F.startswith(F.coalesce(m["attrs"]["property"], F.lit("")), F.lit("product:")))
    return (page_type() == "product") | F.coalesce(F.lower(kind).isin("product", "og:product"), F.lit(False)) | prop | F.coalesce(F.lower("body_class").rlike(r"\b(?:single-product|product-page|product-template)\b"), F.lit(False))


#: Page filters by name: a condition over the row of facts.
FILTERS: dict[str, Callable[[], Column]] = {"product": is_product}


def page_filter(name: str):
    """Register a condition over facts under `name`."""

    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        FILTERS[name] = f
        return f

    return add


@page_filter("any_product")
def _any_product() -> Column:
    """is_product, or a button or form that puts something into a cart."""
    cart = F.exists("anchors", lambda a: F.coalesce(a["attrs"]["class"], F.lit("")).rlike(r"(?i)add[-_]?to[-_]?cart")) | F.exists("scripts", lambda t: t.rlike(r"(?i)add[-_]?to[-_]?cart"))
    return is_product() | cart


def filtered(facts: DataFrame, *names: str) -> DataFrame:
    """The facts of pages that meet all named filters."""
    for name in names:
        facts = facts.where(F.coalesce(FILTERS[name](), F.lit(False)))
    return facts


@dataclass(frozen=True)
class Rule:
    """What a page may break. scope: what `when` and `message` are given, 'head' and 'page' the row of facts (None), 'h1', 'image' and 'link' one of those."""

    code: str
    element: str
    severity: str
    category: str
    scope: str
    when: Callable[[Column | None], Column]
    message: Callable[[Column | None], Column] | None = None
    strict: bool = False

    def issue(self, x: Column | None = None) -> Column:
        text = self.message(x) if self.message else F.lit(self.code.replace("_", " ").capitalize())
        made = F.struct(*[F.lit(v).alias(n) for n, v in (("issue_code", self.code), ("element_type", self.element), ("severity", self.severity), ("category", self.category))], text.alias("message"))
        return F.when(self.when(x), made)


def _title(_=None) -> Column:
    return F.col("head_title")


def _description(_=None) -> Column:
    return _meta("name", "description", True)


def _says(text: str, value: Callable[[Column], Column], shown: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(text), value(x).cast("string"), F.lit(" characters"), *([F.lit(": "), shown(x)] if shown else []))


def _kilobytes(i: Column) -> Column:
    return F.when(F.startswith(i["src"], F.lit("data:image")), F.length(i["src"]) / 1024)


_size = lambda f: lambda x: F.length(f(x))
#: Codes, severities, categories and limits.
RULES = [
    Rule("MISSING_TITLE", "title", "CRITICAL", "HEAD", "head", lambda x: _title().isNull()),
    Rule("EMPTY_TITLE", "title", "CRITICAL", "HEAD", "head", lambda x: _title() == ""),
    Rule("TITLE_TOO_SHORT", "title", "WARNING", "HEAD", "head", lambda x: F.length(_title()).between(1, 9), _says("Title has ", _size(_title))),
    Rule("TITLE_TOO_LONG", "title", "WARNING", "HEAD", "head", lambda x: F.length(_title()) > 60, _says("Title has ", _size(_title), lambda x: F.left(_title(), F.lit(50)))),
    Rule("MISSING_META_DESC", "meta_description", "WARNING", "HEAD", "head", lambda x: _description().isNull()),
    Rule("EMPTY_META_DESC", "meta_description", "WARNING", "HEAD", "head", lambda x: _description() == ""),
    Rule("META_DESC_TOO_SHORT", "meta_description", "INFO", "HEAD", "head", lambda x: F.length(_description()).between(1, 49), _says("Meta description has ", _size(_description))),
    Rule("META_DESC_TOO_LONG", "meta_description", "INFO", "HEAD", "head", lambda x: F.length(_description()) > 160, _says("Meta description has ", _size(_description))),
    Rule("MISSING_CANONICAL", "canonical", "WARNING", "HEAD", "head", lambda x: _canonical(True).isNull()),
    Rule("EMPTY_CANONICAL", "canonical", "WARNING", "HEAD", "head", lambda x: _canonical(True) == ""),
    Rule("MISSING_CHARSET", "meta_charset", "CRITICAL", "HEAD", "head", lambda x: ~F.exists("metas", lambda m: m["in_head"] & m["attrs"]["charset"].isNotNull())),
    Rule("MISSING_VIEWPORT", "meta_viewport", "CRITICAL", "HEAD", "head", lambda x: _meta("name", "viewport", True).isNull()),
    Rule("MISSING_H1", "h1", "CRITICAL", "HEADINGS", "page", lambda x: F.col("has_body") & ~F.exists("headings", lambda h: h["level"] == 1)),
    Rule("MISSING", "doctype", "CRITICAL", "HTML", "page", lambda x: ~F.col("has_doctype"), strict=True),
    Rule("MISSING_ROOT", "html", "CRITICAL", "HTML", "page", lambda x: ~F.col("has_root"), strict=True),
    Rule("EMPTY_H1", "h1", "CRITICAL", "CONTENT", "h1", lambda h: (h["text"] == "") & ~h["direct_img"]),
    Rule("MISSING_ALT", "image", "CRITICAL", "CONTENT", "image", lambda i: i["alt"].isNull()),
    Rule("EMPTY_ALT", "image", "WARNING", "CONTENT", "image", lambda i: F.trim(i["alt"]) == ""),
    Rule("MISSING_SRC", "image", "CRITICAL", "TECHNICAL", "image", lambda i: F.coalesce(i["src"], F.lit("")) == ""),
    Rule("CRITICAL_BASE64_BLOAT", "image", "CRITICAL", "PERFORMANCE", "image", lambda i: _kilobytes(i) > 100),
    Rule("LARGE_BASE64_IMG", "image", "WARNING", "PERFORMANCE", "image", lambda i: (_kilobytes(i) > 20) & (_kilobytes(i) <= 100)),
    Rule("EMPTY_HREF", "anchor", "WARNING", "LINKS", "link", lambda a: a["bare"] == ""),
    Rule("URL_TOO_LONG", "anchor", "WARNING", "LINKS", "link", lambda a: F.length(a["bare"]) > 200, _says("URL has ", lambda a: F.length(a["href"]))),
    Rule("BROKEN_LINK", "anchor", "CRITICAL", "LINKS", "link", lambda a: a["status"] == 404),
    Rule("HTTP_ERROR", "anchor", "WARNING", "LINKS", "link", lambda a: (a["status"] >= 400) & (a["status"] != 404), lambda a: F.concat(F.lit("Link answers with "), a["status"].cast("string"))),
    Rule("URL_SPACE", "anchor", "WARNING", "SEO", "link", lambda a: a["inside"] & (a["path"].contains("%20") | a["path"].contains(" "))),
    Rule("URL_UPPERCASE", "anchor", "INFO", "SEO", "link", lambda a: a["inside"] & a["path"].rlike(r"\p{Lu}")),
    Rule("URL_UNDERSCORE", "anchor", "INFO", "SEO", "link", lambda a: a["inside"] & a["path"].contains("_")),
    Rule("URL_UNSAFE_CHAR", "anchor", "WARNING", "SEO", "link", lambda a: a["inside"] & a["path"].rlike(r"[(),;~'+\[\]*]")),
    Rule("URL_DOUBLE_SLASH", "anchor", "WARNING", "SEO", "link", lambda a: a["inside"] & a["path"].contains("//")),
]
_ISSUES = "array<struct<issue_code:string,element_type:string,severity:string,category:string,message:string>>"
#: Over how many tasks the links to one URL are spread when they meet its status.
LINK_SALTS = 16


def rule_catalogue(spark, rules: list[Rule] = RULES) -> DataFrame:
    """(issue_code, element_type, severity, category, strict) of the declared rules."""
    return spark.createDataFrame([(r.code, r.element, r.severity, r.category, r.strict) for r in rules], "issue_code string, element_type string, severity string, category string, strict boolean")


def issues(facts: DataFrame, statuses: DataFrame | None = None, strict: bool = False, rules: list[Rule] = RULES) -> DataFrame:
    """(page_id, url, issue_code, element_type, severity, category, message): every rule that a page breaks.

    Head rules apply to pages with a head. statuses: (id, url, status_code), for
    links to broken pages; a URL has the status of its row of greatest id. strict
    adds the rules on the doctype and the root element.
    """
    used = [r for r in rules if strict or not r.strict]
    of = lambda scope, x=None: F.array(*[r.issue(x) for r in used if r.scope == scope]).cast(_ISSUES)
    each = lambda scope, items: F.flatten(F.transform(items, lambda x: of(scope, x)))
    page = F.concat(
        F.when(F.col("has_head"), of("head")).otherwise(F.array().cast(_ISSUES)),
        of("page"),
        each("h1", F.filter("headings", lambda h: h["level"] == 1)),
        each("image", F.col("images")),
    )
    kept = lambda found: F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")
    whole = facts.select("page_id", "url", kept(page))

    href = F.col("a.attrs.href")
    bare = F.trim(href)
    links = facts.select("page_id", "url", F.explode("anchors").alias("a")).where(href.isNotNull()).select("page_id", "url", href.alias("href"), bare.alias("bare"))
    if statuses is not None:
        last = statuses.where("url IS NOT NULL").groupBy(F.col("url").alias("t")).agg(F.max_by("status_code", "id").alias("status"))
        bad = last.where("status >= 400").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LINK_SALTS - 1))))
        target, salt = urls.without_fragment(urls.joined(F.col("url"), F.col("bare"))), F.pmod(F.xxhash64("page_id", "bare"), F.lit(LINK_SALTS)).cast("int")
        links = links.withColumn("t", target).withColumn("salt", salt).join(bad, ["t", "salt"], "left")
    else:
        links = links.withColumn("status", F.lit(None).cast("int"))
    bare = F.col("bare")
    inside = (bare != "") & ~bare.rlike(r"(?i)^(?:#|mailto:|tel:|javascript:)") & (urls.link_kind(F.col("url"), bare) != "external")
    link = links.select("page_id", "url", F.struct("href", "bare", "status", inside.alias("inside"), urls.path(bare).alias("path")).alias("x"))
    return whole.unionAll(link.select("page_id", "url", kept(of("link", F.col("x"))))).select("page_id", "url", "i.*")


def without_ignored(found: DataFrame, ignored: list[str]) -> DataFrame:
    """Issues whose message holds none of the ignored strings."""
    return found.where(~F.exists(F.array(*map(F.lit, ignored)), lambda x: F.contains("message", x))) if ignored else found


def emails(facts: DataFrame) -> DataFrame:
    """(page_id, email): mailto targets and addresses in the text, spelled-out signs undone, in lower case; each once a page."""
    text = F.col("body_text")
    for written, sign in ((r"\s*[\[(]\s*at\s*[\])]\s*", "@"), (r"\s*[\[(]\s*dot\s*[\])]\s*", ".")):
        text = F.regexp_replace(text, "(?i)" + written, sign)
    written = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0))
    hrefs = F.filter(F.transform("anchors", lambda a: a["attrs"]["href"]), lambda h: h.rlike(r"(?i)^mailto:[^@]+@[^@?]+\.[^@?]+"))
    mailed = F.transform(hrefs, lambda h: F.regexp_replace(h, r"(?i)^mailto:|\?.*$", ""))
    return facts.select("page_id", F.explode(F.array_distinct(F.transform(F.concat(written, mailed), F.lower))).alias("email"))


def email_scope(found: DataFrame, pages: DataFrame) -> DataFrame:
    """The emails whose domain is their page's host without www."""
    hosts = pages.select(F.col("id").alias("page_id"), urls.bare_host(F.col("url")).alias("h"))
    return found.join(hosts, "page_id").where(F.substring_index("email", "@", -1) == F.col("h")).select("page_id", "email")
