"""Nested text (JSON, Python notation, quoted any number of times) into flat tables with parent links.

The structural index of notation.py turns the bytes of a whole batch into members
and containers. From there the batch is flattened level by level on Arrow buffers:
the children of a level are one list array, its offsets give each child's parent
index, and record ids and paths are taken along that index. No text is read by
itself, at no depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.operators import notation

_FOUND = pa.schema([("field", pa.string()), ("record_id", pa.int64()), ("node", pa.string())])
_NODES = pa.schema([("field", pa.string()), ("record_id", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("value", pa.string())])
_OBJECTS = pa.schema(
    [("field", pa.string()), ("record_id", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("shape", pa.string()), ("position", pa.int32()), ("members", pa.map_(pa.string(), pa.string()))]
)
_DDL = {
    "found": "field string, record_id long, node string",
    "nodes": "field string, record_id long, node string, parent string, key string, kind string, value string",
    "objects": "field string, record_id long, node string, parent string, shape string, position int, members map<string,string>",
}
_KINDS = pa.array(["scalar", "null", "object", "array"])
#: Bytes of text that are indexed at a time, unless one text is longer.
SLICE_BYTES = 4_000_000


def flatten_batch(field: str, ids: pa.Array, texts: pa.Array, form: str = "found") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in one of the forms found, nodes, objects; a record batch per level."""
    data, offsets = notation.buffer_of(texts)
    rows = np.arange(len(texts))
    while len(rows):
        members, (data, offsets, quoted) = notation.read(data, offsets)
        yield from _levels(field, ids.take(pa.array(rows)), members, form)
        rows = rows[quoted]


def _last_of_each_key(members: notation.Members, at: np.ndarray, parent: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which of the members `at` are the last of their key in their object."""
    code = keys.dictionary_encode()
    pair = parent * len(code.dictionary) + code.indices.to_numpy()
    if pc.count_distinct(pa.array(pair)).as_py() == len(pair):
        return np.ones(len(at), bool)
    _, last = np.unique(pair[::-1], return_index=True)
    kept = np.zeros(len(at), bool)
    kept[len(at) - 1 - last] = True
    return kept | members.in_array[at]


def _levels(field: str, ids: pa.Array, m: notation.Members, form: str) -> Iterator[pa.RecordBatch]:
    ends = np.searchsorted(m.level, np.arange(1, m.level.max(initial=0) + 2))
    holders = np.arange(ends[0])  # members of the level above that are containers
    record, path, shape = ids.take(pa.array(m.row[holders])), None, None
    if form == "objects":
        plain = np.flatnonzero(~m.is_array[holders])
        yield _objects(field, m, holders[plain], record.take(pa.array(plain)), None, None, None)
    index = np.full(len(m.row) + 1, -1)
    for start, end in zip(ends[:-1], ends[1:]):
        index[holders] = np.arange(len(holders))
        children = np.arange(start, end)
        home = index[m.parent[children]]
        index[holders] = -1
        children, home = children[home >= 0], home[home >= 0]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(home, minlength=len(holders)))]).astype(np.int32)), pa.array(children))
        parent, at = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
        keys = m.keys(at)
        kept = np.flatnonzero(_last_of_each_key(m, at, parent, keys) & (m.container[at] | (form == "nodes")))
        at, parent, keys = at[kept], pa.array(parent[kept]), keys.take(pa.array(kept))
        record = record.take(parent)
        above = path.take(parent) if path is not None else None
        path = pc.binary_join_element_wise(above, keys, "/") if above is not None else keys
        if form == "objects":
            step = pc.if_else(pa.array(m.in_array[at]), "*", keys)
            shape = pc.binary_join_element_wise(shape.take(parent), step, "/") if shape is not None else step
        if form == "nodes":
            values, null = m.values(at)
            kind = np.where(m.container[at], 2 + m.is_array[at], null.astype(np.int64))
            root = above if above is not None else pa.array([""] * len(at), pa.string())
            yield pa.record_batch([pa.array([field] * len(at), pa.string()), record, path, root, keys, _KINDS.take(pa.array(kind)), values], schema=_NODES)
        else:
            plain = np.flatnonzero(m.container[at] & ~m.is_array[at] & (m.in_array[at] | (form == "objects")))
            chosen = pa.array(plain)
            if form == "found":
                yield pa.record_batch([pa.array([field] * len(plain), pa.string()), record.take(chosen), path.take(chosen)], schema=_FOUND)
            else:
                yield _objects(field, m, at[plain], record.take(chosen), path.take(chosen), above.take(chosen) if above is not None else None, shape.take(chosen))
        deeper = np.flatnonzero(m.container[at])
        holders, record, path = at[deeper], record.take(pa.array(deeper)), path.take(pa.array(deeper))
        shape = shape.take(pa.array(deeper)) if shape is not None else None
        if not len(holders):
            return


def _objects(field: str, m: notation.Members, at: np.ndarray, record: pa.Array, path: pa.Array | None, above: pa.Array | None, shape: pa.Array | None) -> pa.RecordBatch:
    """One row for each object, with its scalar members."""
    empty = pa.array([""] * len(at), pa.string())
    index = np.full(len(m.row) + 1, -1)
    index[at] = np.arange(len(at))
    kids = np.flatnonzero(index[m.parent] >= 0)
    kids = kids[~m.container[kids]]
    keys = m.keys(kids)
    # a scalar whose key comes again, as a scalar or not, gives way to the later one
    every = np.flatnonzero(index[m.parent] >= 0)
    last = every[_last_of_each_key(m, every, index[m.parent[every]], m.keys(every))]
    chosen = np.flatnonzero(np.isin(kids, last, assume_unique=True))
    kids, keys = kids[chosen], keys.take(pa.array(chosen))
    counts = np.bincount(index[m.parent[kids]], minlength=len(at))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    members = pa.MapArray.from_arrays(offsets, keys, m.values(kids)[0])
    position = pa.array(np.where(m.in_array[at], m.position[at], 0).astype(np.int32), mask=~m.in_array[at])
    node = empty if path is None else path
    return pa.record_batch([pa.array([field] * len(at), pa.string()), record, node, empty if above is None else above, empty if shape is None else shape, position, members], schema=_OBJECTS)


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_BYTES, side="right")))
        yield ids.slice(start, end - start), texts.slice(start, end - start)
        start = end


def flatten_nested(df: DataFrame, id_column: str, fields: dict[str, str], form: str = "found") -> DataFrame:
    """Flat rows of the nested texts of `df`.

    fields: column -> name of the field in the result. Forms:

    * found: (field, record_id, node) of the objects that are elements of arrays;
    * nodes: (field, record_id, node, parent, key, kind, value), one row for each
      member of each object and array; kind is object, array, scalar or null,
      value the scalar as it is written, strings without quotes and escapes;
    * objects: (field, record_id, node, parent, shape, position, members), one row
      for each object, the outermost too, with its scalar members as a map. shape
      is the path with '*' for each position: the rows of one shape are one flat
      table, and parent leads to the row that holds it.

    node is the path from the root, parent that of the object or array that holds
    it; '' is the root. Null, blank, broken and scalar texts give no row; quoting
    is undone however often it was done, nesting may have any depth. A key that
    repeats within an object counts once, with its last value. A record id that
    repeats gives its rows each time. Rows without an id have a null record_id.
    """
    holds = lambda c: (F.instr(c, "[") > 0) | (F.instr(c, "{") > 0) | (F.instr(c, "(") > 0)
    listed = lambda c: ((F.instr(c, "[") > 0) | (F.instr(c, "(") > 0)) & (F.instr(c, "{") > 0)
    columns = [F.when(listed(c) if form == "found" else holds(c), F.col(c)).alias(f"t{i}") for i, c in enumerate(fields)]
    narrow = df.select(F.col(id_column).cast("long").alias("record_id"), *columns).where(F.coalesce(*[f"t{i}" for i in range(len(fields))]).isNotNull())
    names = list(fields.values())

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, name in enumerate(names):
                texts = batch.column(i + 1)
                present = pc.is_valid(texts)
                for own, part in _slices(ids.filter(present), texts.filter(present)):
                    yield from flatten_batch(name, own, part, form)

    return narrow.mapInArrow(run, _DDL[form])


def nested_fields(requests: DataFrame, audit_issues: DataFrame, form: str = "found") -> DataFrame:
    """flatten_nested over the nested fields of both tables."""
    of_requests = {c: f"requests.{c}" for c in ("redirect_chain", "headers", "timers")}
    return flatten_nested(requests, "id", of_requests, form).unionByName(flatten_nested(audit_issues, "id", {"details": "audit_issues.details"}, form))
