import json
import random
from collections import Counter

import pyarrow as pa

from sitelake.operators import nested, skew

LINKS = "id long, source_url string, target_url string, bucket string, salt int"


def links(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1) for i, (s, t) in enumerate(rows)], LINKS)


def test_salted_counts_match_a_plain_count(spark):
    rows = [("a", "hot")] * 700 + [(f"s{i % 50}", f"t{i % 90}") for i in range(300)] + [(None, "hot"), ("", None), ("", "")]
    df = links(spark, rows)
    got = {r["url"]: (r["in_links"], r["out_links"]) for r in skew.url_link_counts(df).collect()}
    inn, out = Counter(t for _, t in rows if t is not None), Counter(s for s, _ in rows if s is not None)
    assert got == {u: (inn[u], out[u]) for u in inn | out}
    pairs = {(s, t) for s, t in rows if s is not None and t is not None}
    got = {r["url"]: (r["linking_pages"], r["linked_targets"]) for r in skew.url_neighbour_counts(df).collect()}
    assert got == {u: (sum(t == u for _, t in pairs), sum(s == u for s, _ in pairs)) for p in pairs for u in p}


def test_heavy_keys_are_found_and_salted(spark):
    df = links(spark, [("a", "hot")] * 900 + [(f"s{i}", f"t{i}") for i in range(100)])
    assert len(skew.heavy_buckets(df, ["target_url"], 0.1)) == 1
    assert {tuple(r) for r in skew.heavy_urls(df).collect()} == {("target_url", "hot"), ("source_url", "a")}


def test_empty_links(spark):
    df = links(spark, [])
    assert skew.url_link_counts(df).count() == skew.heavy_urls(df).count() == 0


def brute(value, path=()):
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, (list, tuple)) else ():
        if isinstance(value, (list, tuple)) and isinstance(v, dict):
            yield "/".join(map(str, (*path, k)))
        yield from brute(v, (*path, k))


def brute_nodes(value, path=()):
    """(node, kind, text) of all members, as the operator writes them."""
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, (list, tuple)) else ():
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, (list, tuple)) else "null" if v is None else "scalar"
        text = None if kind != "scalar" else v if isinstance(v, str) else json.dumps(v)
        yield "/".join(map(str, (*path, k))), kind, text
        yield from brute_nodes(v, (*path, k))


def made(rng, depth=4):
    turn = rng.randrange(9 if depth else 6)
    if turn < 2:
        return "".join(rng.choice("ab'\"\\{}[](),: \t\n/é漢😀\x07") for _ in range(rng.randrange(7)))
    if turn < 6:
        return (None, True, False, -3, 2.5, 10**20)[rng.randrange(6)]
    if turn < 8:
        return {"k" + "".join(rng.choice("kv'\" é\\") for _ in range(rng.randrange(4))): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [made(rng, depth - 1) for _ in range(rng.randrange(4))]


def flat(texts, form):
    out = []
    for batch in nested.flatten_batch("f", pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), form):
        out += batch.to_pylist()
    return out


def test_nested_texts_against_a_reader():
    rng = random.Random(8)
    texts, want = [], []
    write = [json.dumps, lambda v: json.dumps(v, ensure_ascii=False), lambda v: json.dumps(v, indent=1), repr, lambda v: json.dumps(v, separators=(",", ":"))]
    while len(texts) < 3000:
        value = made(rng)
        if not isinstance(value, (dict, list)):
            continue
        text = rng.choice(write)(value)
        whole = rng.random() < 0.7
        if not whole:
            text = text[: rng.randrange(len(text))]
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2, 3))):
            text = rng.choice((json.dumps, repr))(text)
        texts.append(text)
        want += [(len(texts) - 1, *n) for n in (brute_nodes(value) if whole else ())]
    got = [(r["record_id"], r["node"], r["kind"], r["value"]) for r in flat(texts, "nodes")]
    plain = lambda rows: sorted((i, n, k, v or "") for i, n, k, v in rows)
    assert plain(got) == plain(want)
    objects = flat(texts, "objects")
    assert sorted((r["record_id"], r["node"]) for r in objects if r["node"]) == sorted((i, n) for i, n, k, _ in want if k == "object")
    members = {(r["record_id"], f"{r['node']}/{k}".lstrip("/"), v) for r in objects for k, v in r["members"]}
    assert members == {(r["record_id"], r["node"], r["value"]) for r in flat(texts, "nodes") if r["kind"] in ("scalar", "null") and r["key"].startswith("k")}


def test_nested_notations(spark):
    value = {"a": [{"b": [1, {"c": None}], "it's": "x"}, [], {"d": [[{"e": True}]]}], "f": {"g": [{}]}}
    many = json.dumps(value)
    for _ in range(10):
        many = json.dumps(many)
    texts = [json.dumps(value), repr(value), json.dumps(json.dumps(value)), repr(json.dumps(value)), json.dumps(repr(value)), many, json.dumps(value)[:-3], "", "  ", None, "null", "[", "[{}", "7", "[]", "nonsense {[}]"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, details string, node int")
    got = nested.flatten_nested(df, "id", {"details": "d"}).collect()
    assert sorted((r["record_id"], r["node"]) for r in got) == sorted((i, n) for i in range(6) for n in brute(value))
    nodes = nested.flatten_nested(df.where("id < 1"), "id", {"details": "d"}, "nodes").collect()
    by = {r["node"]: r for r in nodes}
    assert by["a/0/it's"]["value"] == "x" and by["a/0/it's"]["parent"] == "a/0" and by["a/0/b/1/c"]["kind"] == "null" and by["a"]["parent"] == ""
    rows = nested.flatten_nested(df.where("id < 1"), "id", {"details": "d"}, "objects").collect()
    assert {(r["node"], r["parent"], r["shape"], r["position"]) for r in rows} == {
        ("", "", "", None), ("a/0", "a", "a/*", 0), ("a/0/b/1", "a/0/b", "a/*/b/*", 1), ("a/2", "a", "a/*", 2), ("a/2/d/0/0", "a/2/d/0", "a/*/d/*/*", 0), ("f", "", "f", None), ("f/g/0", "f/g", "f/g/*", 0)
    }


def test_nested_odd_texts():
    found = lambda t: [r["node"] for r in flat([t], "found")]
    assert found('{"a": [{"b": 1}], "a": 2}') == [] and found('{"a": 2, "a": [{}]}') == ["a/0"]
    assert found("({},)") == ["0"] and found("({})") == [] and found("[({}, 1)]") == ["0/0"] and found("[{},]") == ["0"] and found("{1: [{}]}") == ["1/0"]
    for broken in ("[{}] x", "[{}]]", "[{]}", "[,{}]", '[{"a" 1}]', '[{"a":}]', "[{} {}]", "[{}, nope]", "[b'x', {}]", "[{}, 'x", '[{"a": 1 2}]', "{[{}]}", "[{1, 2}]", "[{}\\]"):
        assert found(broken) == []
    deep = "[" * 3000 + "{}" + "]" * 3000
    assert found(deep) == ["/".join("0" * 3000)] and found("[" * 100000) == []
    assert [r["value"] for r in flat(['["\\ud83d\\ude00\\u00e9\\ud83d", "\\q\\u12"]'], "nodes")] == ["😀é?", "\\q\\u12"]
    assert flat([], "found") == flat([""], "nodes") == []


def test_nested_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "id long, details string")
    assert all(nested.flatten_nested(empty, "id", {"details": "d"}, form).count() == 0 for form in ("found", "nodes", "objects"))
    twice = spark.createDataFrame([(1, '[{"a": 1}]')] * 2 + [(None, '[{"a": 1}]')], "id long, details string")
    assert nested.flatten_nested(twice, "id", {"details": "d"}).count() == 3
    long = spark.createDataFrame([(1, "[" + ",".join(['{"a":"%s"}' % ("x" * 50)] * 20000) + "]"), (2, "[" * 100000)], "id long, details string")
    assert nested.flatten_nested(long, "id", {"details": "d"}).count() == 20000
