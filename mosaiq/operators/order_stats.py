"""Exact order statistics of large groups, also of all groups but one or two, from small rank tables.

Values are counted by range and group. A range that holds a wanted rank is counted again in finer ranges until it has at
most GATHER values; then its values are gathered with their counts. Everything else stays a count of a range, so a task
holds ranges and the values of a few of them, never a whole group. Leaving out a group subtracts its counts: any number of
such sets is served by rank searches in one table, and no row meets a set. The median of |x - median| is bracketed in the
same table by the least and the largest deviation in each range.

Every result equals Spark's exact `percentile` to the bit. Null values do not count; NaN and infinite ones are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from mosaiq.sources.sinks import drop_table, stage_table

RANGES, GATHER = 1024, 1 << 14
#: Rows of wanted ranges that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


@dataclass
class Ranks:
    """Disjoint ranges of values with their counts by group; low equals high where the values are known."""

    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray  # groups x ranges
    largest: np.ndarray  # by group; -inf without values

    @classmethod
    def of(cls, rows: pd.DataFrame, groups: list) -> Ranks:
        edges, at = np.unique(rows["low"].to_numpy(), return_inverse=True)
        high = np.empty(len(edges))
        high[at] = rows["high"].to_numpy()
        of = pd.Categorical(rows["grp"], categories=groups).codes.astype(np.int64)
        if (of < 0).any():
            raise ValueError("a group is not among the given groups")
        counts, largest = np.zeros((len(groups), len(edges)), np.int64), np.full(len(groups), -np.inf)
        np.add.at(counts, (of, at), rows["n"].to_numpy())
        np.maximum.at(largest, of, rows["top"].to_numpy())
        return cls(edges, high, counts, largest)

    def without(self, per_group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sum over all groups but a and b of each set; -1 leaves out none."""
        padded = np.append(per_group, 0)
        return per_group.sum() - padded[a] - np.where(a == b, 0, padded[b])

    def kth(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """By set the key of the range that holds the rank (from 0), ranges taken in the order of keys: a binary search over counts."""
        order = np.argsort(keys, kind="stable")
        cum = np.cumsum(np.vstack([self.counts[:, order], np.zeros((1, len(order)), np.int64)]), axis=1)
        total = cum.sum(axis=0)
        low, high = np.zeros(len(a), np.int64), np.full(len(a), len(order) - 1)
        while (low < high).any():
            mid = (low + high) // 2
            enough = total[mid] - cum[a, mid] - np.where(a == b, 0, cum[b, mid]) > rank
            low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
        return keys[order][low]

    def maximum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest value outside of a and b: one of the three groups with the largest values."""
        out = np.full(len(a), -np.inf)
        for g in np.argsort(-self.largest, kind="stable")[:3][::-1]:
            out = np.where((a == g) | (b == g), out, np.maximum(out, self.largest[g]))
        return out

    def mark(self, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The ranges of unknown values that may hold the rank, when a range's values lie between low and high."""
        wanted = np.zeros(len(self.low), bool)
        if len(a):
            for least, most in set(zip(self.kth(low, a, b, rank).tolist(), self.kth(high, a, b, rank).tolist())):
                wanted |= (low <= most) & (high >= least)
        return wanted & (self.low < self.high)

    def quantile(self, keys: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
        """Linear interpolation between the two neighbouring ranks, by the formula of Spark's percentile."""
        at = (n - 1) * q
        lower, higher = np.floor(at), np.ceil(at)
        x, y = (self.kth(keys, a, b, r.astype(np.int64)) for r in (lower, higher))
        return np.where((higher == lower) | (x == y), x, (higher - at) * x + (at - lower) * y)

    def deviations(self, median: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest |x - median| in each range."""
        below, above = np.abs(self.low - median), np.abs(self.high - median)
        inside = (self.low <= median) & (self.high >= median)
        return np.where(inside, 0.0, np.minimum(below, above)), np.maximum(below, above)


def _sets(groups: list, leave_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the groups that each set leaves out: none, one (a = b), or all pairs a <= b."""
    n = len(groups)
    if not leave_out:
        return np.array([-1]), np.array([-1])
    if leave_out == 1:
        return np.arange(n), np.arange(n)
    return np.triu_indices(n)


def _unresolved(ranks: Ranks, a: np.ndarray, b: np.ndarray, probs: list[float], mad: bool) -> np.ndarray:
    """Marks the ranges whose values must be known better."""
    n = ranks.without(ranks.counts.sum(axis=1), a, b)
    a, b, n = a[n > 0], b[n > 0], n[n > 0]
    wanted = np.zeros(len(ranks.low), bool)
    for q in probs:
        for side in (np.floor, np.ceil):
            wanted |= ranks.mark(ranks.low, ranks.high, a, b, side((n - 1) * q).astype(np.int64))
    if mad and not wanted.any() and len(n):
        median = ranks.quantile(ranks.low, n, a, b, 0.5)
        for m in np.unique(median):
            own = median == m
            for side in (np.floor, np.ceil):
                wanted |= ranks.mark(*ranks.deviations(m), a[own], b[own], side((n[own] - 1) * 0.5).astype(np.int64))
    return wanted


def _answers(ranks: Ranks, a: np.ndarray, b: np.ndarray, probs: list[float], mad: bool) -> pd.DataFrame:
    n = ranks.without(ranks.counts.sum(axis=1), a, b)
    some = n > 0
    q = np.full((len(n), len(probs)), np.nan)
    for k, p in enumerate(probs):
        q[some, k] = ranks.quantile(ranks.low, n[some], a[some], b[some], p)
    spread = np.zeros(len(n))
    if mad and some.any():
        median = np.full(len(n), np.nan)
        median[some] = ranks.quantile(ranks.low, n[some], a[some], b[some], 0.5)
        for m in np.unique(median[some]):
            own = median == m
            spread[own] = ranks.quantile(ranks.deviations(m)[0], n[own], a[own], b[own], 0.5)
    out = pd.DataFrame({"n": n, "largest": ranks.maximum(a, b) if a[0] >= 0 else ranks.largest.max(), "mad": spread})
    out["q"] = list(q)
    return out


def statistics(rows: DataFrame, value: str | Column, by: list[str], probs: list[float], group: str | None = None, leave_out: int = 0, groups: list | None = None, mad: bool = False) -> DataFrame:
    """One row for each value of `by` and each set of groups: n, largest, q (the quantiles), mad; all but n and mad null without values.

    leave_out 0: one set with all rows; 1: for each group the set of all others (out_a); 2: for each pair the set of all but
    both (out_a <= out_b; equal where only one is left out). groups lists the groups, also those without values; by default
    those with values. Without any row and with no `by` every set has n = 0.
    """
    value = F.col(value) if isinstance(value, str) else value
    kind = StructField("grp", rows.schema[group].dataType if group else LongType())
    keys = by or ["_all"]
    cells = rows.select(*(F.col(c) for c in by), *([] if by else [F.lit(0).alias("_all")]), (F.col(group) if group else F.lit(0).cast("long")).alias("grp"), value.cast("double").alias("v")).filter("v is not null")
    key_fields = [cells.schema[k] for k in keys]
    table_shape = StructType([*key_fields, *StructType.fromDDL("low double, high double"), kind, *StructType.fromDDL("n long, top double")])
    bad = F.max(F.isnan("v") | (F.abs("v") == float("inf")))
    counted = F.when(bad, F.raise_error(F.lit("values must be finite")).cast("bigint")).otherwise(F.count("v")).alias("n")
    size = cells.groupBy(*keys).agg(counted).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("keys")).first()  # one row
    if not group:
        named = [0]
    else:  # one a group; the result has a row a set of them
        named = sorted({r[0] for r in cells.select("grp").distinct().collect()} if groups is None else groups)
    a, b = _sets(named, leave_out)

    def wanted(frame: pd.DataFrame) -> pd.DataFrame:
        ranks = Ranks.of(frame, named)
        marked = np.flatnonzero(_unresolved(ranks, a, b, probs, mad))
        out = frame[keys].iloc[np.zeros(len(marked), int)].reset_index(drop=True)  # with the keys' own types, also without rows
        return out.assign(low=ranks.low[marked], high=ranks.high[marked], n=ranks.counts[:, marked].sum(axis=0))[[*keys, "low", "high", "n"]]

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        out = _answers(Ranks.of(frame, named), a, b, probs, mad)
        for k in keys:
            out[k] = frame[k].iloc[0]
        if leave_out:
            out["out_a"], out["out_b"] = [named[i] for i in a], [named[i] for i in b]
        empty = out["n"] == 0
        out["largest"] = out["largest"].where(~empty)
        out["q"] = [None if e else q for e, q in zip(empty, out["q"])]
        return out[[f.name for f in answer_shape]]

    wanted_shape = StructType([*key_fields, *StructType.fromDDL("low double, high double, n long")])
    outs = [StructField(c, kind.dataType) for c in ("out_a", "out_b")] if leave_out else []
    answer_shape = StructType([*key_fields, *outs, *StructType.fromDDL("n long, largest double, q array<double>, mad double")])
    if (size["most"] or 0) <= GATHER:
        table = cells.select(*keys, F.col("v").alias("low"), F.col("v").alias("high"), "grp", F.lit(1).cast("long").alias("n"), F.col("v").alias("top"))
    else:
        table = _resolved(cells, keys, table_shape, wanted, wanted_shape, size["keys"])
    if not by and not size["keys"] and named:
        none = pd.DataFrame({"_all": [0], "low": [0.0], "high": [0.0], "grp": [named[0]], "n": [0], "top": [-np.inf]})
        table = rows.sparkSession.createDataFrame(none, table_shape)
    found = table.repartition(_parts(rows), *keys).groupBy(*keys).applyInPandas(answer, answer_shape)
    found = found.withColumn("largest", F.nanvl("largest", F.lit(None).cast("double")))
    return found if by else found.drop("_all")


def _parts(df: DataFrame) -> int:
    """Partitions of the Python work by key: small tables are not put into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _resolved(cells: DataFrame, keys: list[str], shape: StructType, wanted, wanted_shape: StructType, size: int) -> DataFrame:
    """The table of ranges in which `wanted` finds nothing more to resolve. It starts with one range a key."""
    whole = Window.partitionBy(*keys)
    first = cells.groupBy(*keys, "grp").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("top"))
    table = stage_table(first.select(*keys, F.min("least").over(whole).alias("low"), F.max("top").over(whole).alias("high"), "grp", "n", "top"), "ranks")
    open_ = table.groupBy(*keys, "low", "high").agg(F.sum("n").alias("n")).filter("low < high")
    while size:
        coarse, table = table, stage_table(_refined(cells, table, open_, keys, size).select(*shape.names), "ranks")
        drop_table(coarse)
        open_ = stage_table(table.repartition(_parts(cells), *keys).groupBy(*keys).applyInPandas(wanted, wanted_shape), "wanted")
        size = open_.count()
    return table


def _refined(cells: DataFrame, table: DataFrame, wanted: DataFrame, keys: list[str], size: int) -> DataFrame:
    """table with each wanted range replaced by finer ranges, or by its values if they are at most GATHER."""
    same = lambda x, y: [x[k].eqNullSafe(y[k]) for k in keys]
    want = wanted.select(*keys, F.col("low").alias("from"), F.col("high").alias("to"), F.col("n").alias("held"))
    if size <= BROADCAST_ROWS:
        want = F.broadcast(want)
    hit = cells.join(want, [*same(cells, want), cells["v"].between(want["from"], want["to"])]).select(*(cells[k] for k in keys), "grp", "v", "from", "to", "held")
    part = F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * RANGES).cast("double")  # monotone in v whatever is rounded
    fine = hit.groupBy(*keys, "grp", "from", F.when(F.col("held") > GATHER, part).otherwise(F.col("v")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("top"))
    within = Window.partitionBy(*keys, "from", "part")
    fine = fine.select(*keys, F.min("least").over(within).alias("low"), F.max("top").over(within).alias("high"), "grp", "n", "top")
    kept = table.join(want, [*same(table, want), table["low"] == want["from"]], "left_anti")
    return kept.unionByName(fine)


def quantiles(rows: DataFrame, value: str | Column, by: list[str], probs: list[float], **sets) -> DataFrame:
    return statistics(rows, value, by, probs, **sets).drop("mad")


def spread(rows: DataFrame, value: str | Column, by: list[str], **sets) -> DataFrame:
    """n, largest, median and mad (the median of |x - median|) of each group or set; mad is 0 without values."""
    found = statistics(rows, value, by, [0.5], mad=True, **sets)
    return found.withColumn("median", F.element_at("q", 1)).drop("q")

