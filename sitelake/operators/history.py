"""A log of commands: read from text, deduplicated, trimmed, counted."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(position, at, command) of a file of records between blank lines: '# time', then lines that begin with '+', one command.

    Records without a command are left out; a time that cannot be read is null.
    Records of one file keep their order, by their place in the file.
    """
    rows = spark.read.option("lineSep", "\n\n").text(path).select("value", F.monotonically_increasing_id().alias("position"))
    lines = F.split("value", "\r?\n")
    own = F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit("+"))), lambda s: F.substring(s, 2, 1 << 30))
    time = F.regexp_extract("value", r"(?m)^# *(.*?) *$", 1)
    return rows.select("position", F.try_to_timestamp(time).alias("at"), F.array_join(own, "\n").alias("command")).where("command <> ''")


def last_occurrences(log: DataFrame, position: str, command: str) -> DataFrame:
    """The row of greatest position of each command; a null command is one of its own. Order by position for the order of the log."""
    return log.groupBy(command).agg(F.max_by(F.struct(*log.columns), position).alias("r")).select("r.*")


def recent(log: DataFrame, position: str, command: str, n: int) -> DataFrame:
    """The last rows of the n commands used last, newest first."""
    return last_occurrences(log, position, command).orderBy(F.desc(position)).limit(n)


def without_ends(log: DataFrame, position: str, first: int = 0, last: int = 0) -> DataFrame:
    """The log without its `first` first and `last` last rows. Positions must differ."""
    if first:
        log = log.join(F.broadcast(log.select(position).orderBy(position).limit(first)), position, "left_anti")  # `first` rows at most
    if last:
        log = log.join(F.broadcast(log.select(position).orderBy(F.desc(position)).limit(last)), position, "left_anti")
    return log


def duplicate_stats(log: DataFrame, command: str) -> DataFrame:
    """One row (total, different, duplicates); null commands are left out."""
    counts = log.where(F.col(command).isNotNull()).groupBy(command).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("different"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def _shell_words(text: str | None) -> int | None:
    if text is None:
        return None
    try:
        return len(shlex.split(text))
    except ValueError:
        return len(text.split())


def word_counts() -> Column:
    """A function of a text column: words as a shell reads them, between white space where quotes do not match; null for null."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(_shell_words).astype("Int32")

    return count
