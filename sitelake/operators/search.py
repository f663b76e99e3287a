"""The predicate language: conditions on one table, compiled to a column by the table's types.

    query     := condition ((AND | OR) condition)*
    condition := [NOT] table.field op value
    op        := = | != | <> | >= | <= | > | < | LIKE | CONTAINS
    value     := '...' | "..." | a number without sign
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "pages": "pages", "requests": "requests", "project": "project", "internal_links": "links", "external_links": "links", "links": "links",
    "audits": "audit_issues", "issues": "audit_issues", "audit_issues": "audit_issues",
}
_SCOPED = {"internal_links": 0, "external_links": 1}
_TOKEN = re.compile(r"\s*(?:(AND|OR|NOT)\b|(\w+)\.(\w+)|(>=|<=|<>|!=|=|>|<|LIKE\b|CONTAINS\b)|'([^']*)'|\"([^\"]*)\"|([0-9.]+))", re.I)


class QueryError(ValueError):
    """The text is no query, or names an unknown or a second table or column."""


@dataclass(frozen=True)
class Condition:
    negated: bool
    alias: str
    field: str
    op: str
    value: str
    joined: str  # AND or OR with what stands before


def parse(text: str) -> list[Condition]:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"syntax error at {text[at:at + 20]!r}")
        tokens.append(m)
        at = m.end()
    found, i, joined = [], 0, "AND"
    while True:
        negated = False
        while i < len(tokens) and (tokens[i][1] or "").upper() == "NOT":
            negated, i = not negated, i + 1
        if i + 2 >= len(tokens) + 0 and i + 3 > len(tokens):
            raise QueryError("a condition is incomplete")
        name, op, value = tokens[i : i + 3]
        if not (name[2] and op[4] and any(value[k] is not None for k in (5, 6, 7))):
            raise QueryError(f"no condition: {text!r}")
        literal = next(value[k] for k in (5, 6, 7) if value[k] is not None)
        found.append(Condition(negated, name[2].lower(), name[3].lower(), op[4].upper(), literal, joined))
        i += 3
        if i == len(tokens):
            break
        joined = (tokens[i][1] or "").upper()
        if joined not in ("AND", "OR"):
            raise QueryError("AND or OR expected")
        i += 1
    aliases = {c.alias for c in found}
    if unknown := aliases - TABLES.keys():
        raise QueryError(f"unknown table {sorted(unknown)}; there are {sorted(TABLES)}")
    if len({TABLES[a] for a in aliases}) > 1:
        raise QueryError("a query is about one table")
    return found


def _numeric(value: str) -> bool:
    return value.replace(".", "", 1).isdigit()


def compile_condition(c: Condition, schema: T.StructType) -> Column:
    kinds = {f.name.lower(): f.dataType for f in schema}
    if c.field not in kinds:
        raise QueryError(f"unknown column {c.field}; there are {sorted(kinds)}")
    col, number = F.col(c.field), isinstance(kinds[c.field], T.NumericType)
    if c.op in ("LIKE", "CONTAINS"):
        pattern = (c.value if c.op == "LIKE" else f"%{c.value}%").lower().replace("'", "''").replace("\\", "\\\\")
        made = F.expr(f"lower(cast({c.field} as string)) LIKE '{pattern}' ESCAPE '\u0001'")
    else:
        equal = c.op in ("=", "!=", "<>")
        if number:
            left, right = col.cast("double"), F.lit(c.value).try_cast("double")
        elif equal and not _numeric(c.value):
            left, right = F.lower(col.cast("string")), F.lit(c.value.lower())
        else:
            left, right = col.cast("string"), F.lit(c.value)
        made = {"=": left == right, "!=": left != right, "<>": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[c.op]
    return ~made if c.negated else made


def search(text: str, tables, columns: list[str] | None = None) -> DataFrame:
    """Rows that match the query. tables: name -> DataFrame. AND binds tighter than OR; null conditions don't match."""
    conditions = parse(text)
    df = tables(TABLES[conditions[0].alias])
    groups: list[Column] = []
    for c in conditions:
        made = compile_condition(c, df.schema)
        if groups and c.joined == "AND":
            groups[-1] = groups[-1] & made
        else:
            groups.append(made)
    where = groups[0]
    for g in groups[1:]:
        where = where | g
    out = df.where(where)
    scopes = {_SCOPED[c.alias] for c in conditions if c.alias in _SCOPED}
    if len(scopes) == 1:
        out = out.where(F.col("is_external") == scopes.pop())
    if columns:
        bad = [x for x in columns if not re.fullmatch(r"\w+", x) or x not in out.columns]
        if bad:
            raise QueryError(f"unknown columns {bad}; there are {out.columns}")
        out = out.select(*columns)
    return out
