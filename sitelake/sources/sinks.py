"""Writing tables: append, first row wins, last row wins, truncate, and flat text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`old` and those rows of `new` whose key it lacks; of repeated new keys the row of least `order`.

    Null keys equal one another. Columns are matched by name.
    """
    fresh = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return old.unionByName(fresh.alias("n").join(old.select(*keys).alias("o"), same, "left_anti"), allowMissingColumns=True)


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`new`, of repeated keys the row of greatest `order`, and the rows of `old` with other keys."""
    fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return fresh.unionByName(old.alias("o").join(fresh.select(*keys).alias("n"), same, "left_anti"), allowMissingColumns=True)


def append_distinct(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with one row a key: that of `old` before that of `new`, then that of least `order`."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "__new"]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("__new", order)).alias("r")).select("r.*")


def truncated(df: DataFrame) -> DataFrame:
    return df.limit(0)


def flat(df: DataFrame) -> DataFrame:
    """The table with arrays, maps and structs as JSON text, as text exports need it."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, folder: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def column_widths(df: DataFrame, most: int = 100) -> DataFrame:
    """(column_name, width) of a sheet: its longest text and two more, `most` at most."""
    longest = [F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(c) for c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.least(F.col(c) + 2, F.lit(most)).alias("width")) for c in df.columns])
    return df.agg(*longest).select(F.explode(pairs).alias("p")).select("p.*")


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Each sheet of a workbook as a CSV folder, with one of the widths of all."""
    widths = None
    for name, df in sheets.items():
        write_csv(df, f"{folder}/{name}")
        own = column_widths(flat(df)).select(F.lit(name).alias("sheet"), "*")
        widths = own if widths is None else widths.unionAll(own)
    if widths is not None:
        write_csv(widths, f"{folder}/widths")


def report_rows(df: DataFrame, lib: str, category: str, name: str) -> DataFrame:
    """(lib, category, name, data): each row as a JSON text, for the table of reports."""
    return df.select(F.lit(lib).alias("lib"), F.lit(category).alias("category"), F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("data"))


def latest_report(reports: DataFrame, **where: str) -> DataFrame:
    """The newest report with the given lib, category or name."""
    for column, value in where.items():
        reports = reports.where(F.col(column) == value)
    return reports.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a sitemap file: the loc of each url element."""
    schema = "loc string"
    return spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema(schema).load(path).select(F.trim("loc").alias("url")).where("url <> ''")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file: its urls column where the first line names one, else each line."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is not None and "urls" in [c.strip().lower() for c in first["value"].split(",")]:
        return spark.read.option("header", True).csv(path).select(F.trim("urls").alias("url")).where("url <> ''")
    return lines.select(F.trim("value").alias("url")).where("url <> ''")
