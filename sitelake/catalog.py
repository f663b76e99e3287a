"""Tables of a crawl by name: scans, schemas, writes; what a user's analysis needs of its data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake.operators import html
from sitelake.operators.search import TABLES
from sitelake.sources import sinks
from sitelake.sources.settings import Settings
from sitelake.sources.tables import read_table

#: Names of the queryable tables beside TABLES; is_external tells the two kinds of links apart and is shown of neither.
_SCOPES = {"internal_links": "is_external = 0", "external_links": "is_external = 1"}
_DEFAULTS = {T.StringType: "", T.IntegerType: 0, T.LongType: 0, T.DoubleType: None, T.BooleanType: None, T.TimestampType: None}


def typed(column: Column, kind: T.DataType) -> Column:
    """Whole numbers: 0 where it is none; fractions: null where it is none or NaN; text: '' for null."""
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.coalesce(column.try_cast(kind), F.lit(0)).cast(kind)
    if isinstance(kind, T.DoubleType):
        number = column.try_cast("double")
        return F.when(~F.isnan(number), number)
    if isinstance(kind, T.StringType):
        return F.coalesce(column.cast("string"), F.lit(""))
    return column.try_cast(kind)


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with the columns of `schema` in their order and types; missing ones have their type's default, others are dropped."""
    have = set(df.columns)
    return df.select(*[(typed(F.col(f.name), f.dataType) if f.name in have else F.lit(_DEFAULTS.get(type(f.dataType))).cast(f.dataType)).alias(f.name) for f in schema])


def decoded(content: Column) -> Column:
    """Text that begins like JSON as a variant, null where it is broken; other text as a variant string."""
    looks = F.regexp_replace(content, r"^\s+", "").rlike(r"^[\[{]")
    return F.when(looks, F.try_parse_json(content)).otherwise(F.try_variant_get(F.parse_json(F.to_json(F.array(content))), "$[0]", "variant"))


class Crawl:
    """One folder of tables, narrowed to a project where one is named."""

    def __init__(self, spark: SparkSession, root: str, project_id: int | None = None, settings: Settings | None = None):
        self.spark, self.root, self.project_id, self.settings = spark, root, project_id, settings or Settings()

    def table(self, name: str) -> DataFrame:
        """The table by any of its names; only the project's rows where the table has a project_id."""
        df = read_table(self.spark, self.root, TABLES.get(name, name))
        if name in _SCOPES:
            df = df.where(_SCOPES[name])
        if self.project_id is not None and "project_id" in df.columns:
            df = df.where(F.col("project_id") == self.project_id)
        return df

    def query(self, text: str, **arguments) -> DataFrame:
        """SQL over the tables by name, with named arguments; what is wrong with it is raised."""
        for name in sorted(set(TABLES.values())):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=arguments)

    def query_or_nothing(self, text: str, **arguments) -> DataFrame:
        """query(), an empty table without columns where it is no valid query."""
        from pyspark.errors import AnalysisException, ParseException

        try:
            return self.query(text, **arguments)
        except (AnalysisException, ParseException):
            return self.spark.createDataFrame([], T.StructType())

    def schemas(self) -> DataFrame:
        """(table_name, column_name, position, type) of what can be queried."""
        rows = []
        for name in sorted({*TABLES.values(), *_SCOPES}):
            columns = [f for f in self.table(name).schema if not (name in _SCOPES and f.name == "is_external")]
            rows += [(name, f.name, i, f.dataType.simpleString()) for i, f in enumerate(columns, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, position int, type string")

    def project(self, project_id: int) -> dict | None:
        found = self.table("project").where(F.col("id") == project_id).first()
        return found.asDict() if found else None

    def page(self, page_id: int) -> dict | None:
        found = self.table("pages").where(F.col("id") == page_id).first()
        return found.asDict() if found else None

    def issues_of(self, page_id: int) -> DataFrame:
        return self.table("audit_issues").where(F.col("page_id") == page_id)

    def facts(self) -> DataFrame:
        return html.parse_pages(self.table("pages").select("id", "url", "content"))

    def images(self) -> DataFrame:
        """The different (page_id, image_url, alt_text, width, height)."""
        return html.images(self.facts()).distinct()

    def elements(self, types: list[str] | None = None, page_ids: list[int] | None = None, decode: bool = False) -> DataFrame:
        """(page_id, element_type, content) rows of the wanted types and pages; decode adds the content as a variant."""
        df = html.stored_elements(self.facts(), types)
        if page_ids is not None:
            df = df.where(F.col("page_id").isin(page_ids))
        return df.withColumn("value", decoded(F.col("content"))) if decode else df

    def save(self, df: DataFrame, name: str, how: str = "append", keys: list[str] | None = None, order: str | None = None) -> None:
        """Write to `name`: replace, append, ignore (the first row of a key wins) or update (the last one does)."""
        path = f"{self.root}/{name}.parquet"
        if how in ("ignore", "update"):
            old = self.spark.read.parquet(path)
            merge = sinks.first_wins if how == "ignore" else sinks.last_wins
            made = merge(old, df, keys, order)
            made.write.mode("overwrite").parquet(f"{path}.part")  # the old rows are read while the new ones are written
            self.spark.read.parquet(f"{path}.part").write.mode("overwrite").parquet(path)
        else:
            df.write.mode("overwrite" if how == "replace" else "append").parquet(path)

    def save_result(self, df: DataFrame, plugin: str, how: str = "replace") -> str:
        """Write a plugin's result to its own table, with the project's id; gives the table's name."""
        name = f"plugin_{plugin}"
        self.save(df if self.project_id is None else df.withColumn("project_id", F.lit(self.project_id)), name, how)
        return name


def shown(df: DataFrame, rows: int | None = 10, as_json: bool = False) -> str:
    """The first rows as a text table or as JSON lines; None for all."""
    part = df if rows is None else df.limit(rows)
    if as_json:
        return "\n".join(json.dumps(json.loads(r), ensure_ascii=False, indent=1) for r in part.toJSON().toLocalIterator())
    found = part.toLocalIterator()
    body = [["" if v is None else str(v) for v in r] for r in found]
    widths = [max(len(c), *(len(r[i]) for r in body)) if body else len(c) for i, c in enumerate(df.columns)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [df.columns, *body])
