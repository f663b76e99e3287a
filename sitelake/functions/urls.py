"""URL parts and tests as column expressions; any string has an answer, null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of pages that can be crawled.
PAGE_EXTENSIONS = (
    "", ".htm", ".html", ".xhtml", ".shtml", ".shtm", ".stm", ".jhtml", ".asp", ".aspx", ".ashx", ".asmx", ".axd", ".mspx", ".jsp", ".jspx", ".do",
    ".action", ".jsf", ".faces", ".php", ".php3", ".php4", ".php5", ".phtml", ".pl", ".cgi", ".fcgi", ".py", ".rb", ".rhtml", ".dll", ".cfm", ".cfml",
    ".yaws", ".lasso", ".nsf", ".xsp", ".hcsp", ".adp",
)
#: scheme, authority and path of a URL, by the syntax of RFC 3986.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def without_end_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def base(url: Column) -> Column:
    """scheme://authority, with http:// where the scheme is missing."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_extract(full, "^[^:/?#]+://[^/?#]*", 0)


def is_relative(url: Column) -> Column:
    return (F.regexp_extract(url, PARTS, 1) == "") & (F.regexp_extract(url, PARTS, 2) == "")


#: scheme, authority, path, query and fragment; a scheme begins with a letter.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def joined(base: Column, reference: Column) -> Column:
    """`reference` resolved against `base`: dot segments are removed, an empty reference gives the base.

    A reference with another scheme stays as it is. White space around and line
    ends within either are ignored; null where either is null.
    """
    tidy = lambda u: F.regexp_replace(F.regexp_replace(u, r"^[\x00- ]+|[\x00- ]+$", ""), r"[\t\r\n]", "")
    part = lambda u, i: F.regexp_extract(u, _SPLIT, i)
    names = ("scheme", "slashes", "host", "path", "query", "fragment")
    parts = lambda u: F.struct(u.alias("whole"), *[part(u, i).alias(n) for i, n in enumerate(names, 1)])
    both = _let(F.struct(tidy(base).alias("b"), tidy(reference).alias("r")), lambda t: F.struct(parts(t["b"]).alias("b"), parts(t["r"]).alias("r")))
    made = _let(both, lambda t: _resolved(t["b"], t["r"]))
    return F.when(base.isNotNull() & reference.isNotNull(), made)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _resolved(b: Column, r: Column) -> Column:
    folder = F.regexp_replace(b["path"], "[^/]+$", "")
    relative = _let(F.split(F.concat(folder, F.lit("/"), r["path"]), "/"), _between_filled)
    split = F.when(F.startswith(r["path"], F.lit("/")), F.split(r["path"], "/")).otherwise(relative)
    walk = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    ends = lambda s: F.when(F.element_at(s, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    walked = _let(split, lambda s: F.array_join(F.concat(F.aggregate(s, F.array().cast("array<string>"), walk), ends(s)), "/"))
    own = r["slashes"] != ""
    own = own & (r["host"] != "")
    path = F.when(own, r["path"]).when(r["path"] == "", b["path"]).otherwise(F.coalesce(F.nullif(walked, F.lit("")), F.lit("/")))
    query = F.when(~own & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
    ready = F.struct(F.when(own, r["host"]).otherwise(b["host"]).alias("host"), path.alias("path"), query.alias("query"))
    scheme = F.lower(b["scheme"])
    made = _let(
        ready,
        lambda t: F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(t["host"] != "", F.concat(F.lit("//"), t["host"])).otherwise(""),
            F.when((t["host"] != "") & (t["path"] != "") & ~F.startswith(t["path"], F.lit("/")), "/").otherwise(""),
            t["path"],
            F.when(t["query"] != "", F.concat(F.lit("?"), t["query"])).otherwise(""),
            F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(""),
        ),
    )
    other = (r["scheme"] != "") & (F.lower(r["scheme"]) != scheme)
    return F.when(r["whole"] == "", b["whole"]).when((b["whole"] == "") | other, r["whole"]).otherwise(made)


def _between_filled(parts: Column) -> Column:
    """The parts without empty ones between the first and the last."""
    last = F.size(parts) - 1
    return F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == last))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"[^/.](\.[^./]*)$", 1))


def has_page_extension(url: Column) -> Column:
    return extension(url).isin(*PAGE_EXTENSIONS)


def is_valid_link(url: Column) -> Column:
    """An absolute http(s) URL of a page, without query and fragment."""
    return scheme(url).isin("http", "https") & (host(url) != "") & has_page_extension(url) & ~url.contains("?") & ~url.contains("#")


def query(url: Column) -> Column:
    """What stands between the first '?' and the fragment, '' for nothing."""
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def without_params(url: Column) -> Column:
    """The URL without query, fragment and the parameters of its last segment."""
    return F.regexp_replace(without_query(url), r";[^/]*$", "")


def segments(url: Column) -> Column:
    """Decoded path segments, the query behind the last; a plus sign stays a plus sign."""
    p = F.regexp_replace(path(url), "^/+|/+$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    asked = query(url)
    whole = F.when(asked != "", F.concat(decoded, F.lit("?"), asked)).otherwise(decoded)
    return F.filter(F.split(whole, "/"), lambda s: s != "")


def is_canonical(source: Column, target: Column) -> Column:
    """Whether the target is a page of the source's host in its plain form."""
    return (host(source) == host(target)) & is_valid_link(target)


def link_flag(source: Column, target: Column) -> Column:
    """0 for a plain page of the same host, 1 for a page of another host, null for what is not kept: other forms of own pages and what is no page."""
    page = scheme(target).isin("http", "https") & (host(target) != "") & has_page_extension(target)
    return F.when(is_canonical(source, target), 0).when(page & (host(source) != host(target)), 1)


def link_kind(source: Column, target: Column) -> Column:
    """same, subdomain or external, by the hosts without www."""
    a, b = bare_host(source), bare_host(target)
    return F.when((b == "") | (a == b), "same").when(F.endswith(b, F.concat(F.lit("."), a)), "subdomain").otherwise("external")
