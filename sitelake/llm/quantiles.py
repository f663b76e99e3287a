"""Exact percentiles per group from one distributed sort.

The rows are first reduced to (group, value, count), a form that merges exactly:
days, partitions or projects combine by adding counts. That table is range-sorted
by group and value. A partition then holds whole groups, except the first and the
last, which may go on in its neighbours; counts of those two per partition give
every group's offsets. Each partition finds its groups' target positions by
itself, and the two neighbouring order statistics of a position are combined by
interpolation, wherever they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.sources.tables import materialise


#: Rows of a result that are passed on at a time.
ROWS = 10_000


def request_values(requests: DataFrame) -> DataFrame:
    """(project_id, day, measure, value): the valid elapsed_time and status_code of each request.

    Valid elapsed_time is not null, not NaN and at least 0; valid status_code is above 0.
    """
    elapsed, status = F.col("elapsed_time"), F.col("status_code")
    both = F.array(
        F.struct(F.lit("elapsed_time").alias("measure"), F.when(~F.isnan(elapsed) & (elapsed >= 0), elapsed).alias("value")),
        F.struct(F.lit("status_code").alias("measure"), F.when(status > 0, status.cast("double")).alias("value")),
    )
    day = F.date_format("created_at", "yyyy-MM-dd")
    rows = requests.select("project_id", day.alias("day"), F.explode(both).alias("m"))
    return rows.select("project_id", "day", "m.measure", "m.value").where("value is not null")


def value_counts(df: DataFrame, groups: Sequence[str], value: str = "value", count: str | None = None) -> DataFrame:
    """(groups, value, n): the mergeable form. `count` names the counts when `df` is such a form already."""
    n = F.sum(count) if count else F.count(F.lit(1))
    return df.groupBy(*groups, F.col(value).alias("value")).agg(n.alias("n"))


def quantiles(counts: DataFrame, groups: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(groups, p, n_values, quantile): percentiles of (groups, value, n), interpolated linearly between neighbours.

    Exact: position p * (n - 1) of the sorted values. A group of one value has
    that value at every p; null groups are groups; an empty table gives no row.
    Null values must have been left out, else they are ignored. Counts that are
    repeated rows of one value add up.
    """
    groups, at = list(groups), [float(p) for p in at]
    clean = counts.where("value is not null and n > 0").select(*groups, "value", "n")
    ordered = clean.repartitionByRange(*groups, "value").sortWithinPartitions(*groups, "value")
    ordered = materialise(ordered.withColumn("pid", F.spark_partition_id()))
    offsets = _offsets(ordered, groups)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*groups).schema)

    def locate(batches):
        rows: list[tuple] = []

        def frame():
            out = pd.DataFrame([r[len(groups) :] for r in rows], columns=["p", "n_values", "weight", "value"])
            for i, name in enumerate(groups):
                out.insert(i, name, pd.Series([r[i] for r in rows], dtype=object))
            return out

        for group, pid, values, n in _runs(batches, groups):
            offset, total = offsets.get((pid, group), (0, None))
            ends = offset + np.cumsum(n)
            total = int(ends[-1]) if total is None else total
            position = np.array(at) * (total - 1)
            low = np.floor(position).astype(np.int64)
            part = position - low
            for ranks, weights in ((low, 1 - part), (np.minimum(low + 1, total - 1), part)):
                here = np.flatnonzero((offset <= ranks) & (ranks < ends[-1]))
                found = values[np.searchsorted(ends, ranks[here], side="right")]
                rows += [(*group, at[i], total, w, v) for i, w, v in zip(here.tolist(), weights[here].tolist(), found.tolist())]
            if len(rows) >= ROWS:
                yield frame()
                rows.clear()
        if rows:
            yield frame()

    found = ordered.mapInPandas(locate, f"{schema}, p double, n_values long, weight double, value double")
    merged = F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("value")).otherwise(0.0))
    return found.groupBy(*groups, "p", "n_values").agg(merged.alias("quantile"))


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else x.item() if isinstance(x, np.generic) else x


def _runs(batches, groups):
    """(group, pid, values, counts) of each run of one group in a sorted partition, batches put together."""
    held, held_pid, values, counts = None, None, [], []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = [pdf[g] for g in groups]
        codes = [pd.factorize(k, use_na_sentinel=False)[0] for k in keys]
        change = np.zeros(len(pdf), bool)
        change[0] = True
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(change), len(pdf))
        value, n, pid = pdf["value"].to_numpy(float), pdf["n"].to_numpy(np.int64), int(pdf["pid"].iloc[0])
        for a, b in zip(starts[:-1], starts[1:]):
            group = tuple(_plain(k.iloc[a]) for k in keys)
            if held is not None and group != held:
                yield held, held_pid, np.concatenate(values), np.concatenate(counts)
                values, counts = [], []
            held, held_pid = group, pid
            values.append(value[a:b])
            counts.append(n[a:b])
    if held is not None:
        yield held, held_pid, np.concatenate(values), np.concatenate(counts)


def _offsets(ordered: DataFrame, groups: list[str]) -> dict:
    """(pid, group) -> (values before the partition, all values), for groups that go over a partition's border.

    Only the first and the last group of each partition can, so two rows a
    partition reach the driver, whatever the number of groups.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*groups).schema)

    def edges(batches):
        first = last = None
        for group, pid, _, n in _runs(batches, groups):
            row = (*group, pid, int(n.sum()))
            first, last = first or row, row
        if first:
            rows = [first] if first is last else [first, last]
            out = pd.DataFrame(rows, columns=[*groups, "pid", "n"])
            for i, g in enumerate(groups):
                out[g] = pd.Series([r[i] for r in rows], dtype=object)
            yield out

    parts: dict = {}
    for r in ordered.mapInPandas(edges, f"{schema}, pid int, n long").collect():
        parts.setdefault(tuple(r[g] for g in groups), []).append((r["pid"], r["n"]))
    offsets = {}
    for group, own in parts.items():
        own.sort()
        total, before = sum(n for _, n in own), 0
        for pid, n in own:
            offsets[pid, group] = (before, total)
            before += n
    return offsets


def slow_or_failing_groups(requests: DataFrame, least: int = 40) -> DataFrame:
    """(project_id, day, measure): project days whose percentiles lie far above the whole table's.

    elapsed_p50: median at least 2 times the table's; elapsed_p95: 95th percentile
    at least 6 times the table's; status_p75: 75th percentile of status_code at
    least 400. Only groups with `least` valid values of the field count.
    """
    counts = materialise(value_counts(request_values(requests), ["project_id", "day", "measure"]))
    days = quantiles(counts, ["project_id", "day", "measure"], [0.5, 0.75, 0.95])
    whole = quantiles(value_counts(counts, ["measure"], count="n"), ["measure"], [0.5, 0.95])
    limits = {(r["measure"], r["p"]): r["quantile"] for r in whole.collect()}  # four numbers
    tests = F.array(
        F.struct(F.lit("elapsed_p50").alias("name"), F.lit("elapsed_time").alias("field"), F.lit(0.5).alias("at"), _limit(limits, "elapsed_time", 0.5, 2).alias("least")),
        F.struct(F.lit("elapsed_p95").alias("name"), F.lit("elapsed_time").alias("field"), F.lit(0.95).alias("at"), _limit(limits, "elapsed_time", 0.95, 6).alias("least")),
        F.struct(F.lit("status_p75").alias("name"), F.lit("status_code").alias("field"), F.lit(0.75).alias("at"), F.lit(400.0).alias("least")),
    )
    rows = days.where(F.col("n_values") >= least).select("*", F.explode(tests).alias("t"))
    hit = (F.col("measure") == F.col("t.field")) & (F.col("p") == F.col("t.at")) & (F.col("quantile") >= F.col("t.least"))
    return rows.where(hit).select("project_id", "day", F.col("t.name").alias("measure"))


def _limit(limits: dict, measure: str, p: float, times: float):
    value = limits.get((measure, p))
    return F.lit(None if value is None else value * times).cast("double")
