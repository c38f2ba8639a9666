"""Robust thresholds, folds, decisions, confusion metrics and their uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.operators import order_stats

METRICS = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "far", "frr")


def with_threshold(found: DataFrame, margin: Column | float, resolution: Column | float) -> DataFrame:
    """min(1, max(0, largest + max(margin * MAD, resolution))) of rows of order_stats.spread; 1 where there are no values."""
    margin, resolution = (c if isinstance(c, Column) else F.lit(float(c)) for c in (margin, resolution))
    robust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("largest") + F.greatest(margin * F.col("mad"), resolution)))
    return found.withColumn("threshold", F.when(F.col("n") == 0, 1.0).otherwise(robust))


def mad_threshold(rows: DataFrame, value: str, by: list[str], margin: Column | float, resolution: Column | float) -> DataFrame:
    """The robust threshold of each group; margin and resolution may be columns of `by`."""
    return with_threshold(order_stats.spread(rows, value, by), margin, resolution)


def fold_thresholds(rows: DataFrame, value: str, by: list[str], margin: Column | float, resolution: Column | float, group: str = "source_id", held_out: str = "held_out", groups: list | None = None) -> DataFrame:
    """The robust threshold of each fold, from the rows of all groups but the held-out one: no row meets a fold."""
    found = order_stats.spread(rows, value, by, group=group, leave_out=1, groups=groups).drop("out_b")
    return with_threshold(found.withColumnRenamed("out_a", held_out), margin, resolution)


def fold_rows(rows: DataFrame, groups: DataFrame, group: str = "source_id", held_out: str = "held_out") -> DataFrame:
    """Each row in the training part of every fold but its own group's. groups has one row a group and is small."""
    return rows.join(F.broadcast(groups.select(F.col(group).alias(held_out))), F.col(group) != F.col(held_out))


def attribution(structural: Column, resnet: Column, temporal: Column, balanced: Column, resnet_over: Column, temporal_over: Column, balanced_over: Column, tie: str = "resnet_only") -> Column:
    """Why a segment is abnormal; a balanced excess goes to the larger stream, and a tie to `tie`."""
    by_balance = F.when(resnet > temporal, "resnet_only").when(temporal > resnet, "temporal_only").otherwise(tie)
    return F.when(structural, "structural").when(resnet_over & temporal_over, "both_streams").when(resnet_over, "resnet_only").when(temporal_over, "temporal_only").when(balanced_over, by_balance).otherwise("none")


LABELS = ("normal", "abnormal")


def known_labels(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, whose labels must be normal or abnormal: any other, null too, is an error that names it."""
    told = {c: F.when(F.col(c).isin(*LABELS), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown label in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("string")) for c in columns}
    return rows.withColumns(told)


def _cells(expected: str, observed: str) -> list[Column]:
    pairs = {"tp": ("abnormal", "abnormal"), "tn": ("normal", "normal"), "fp": ("normal", "abnormal"), "fn": ("abnormal", "normal")}
    return [F.count_if((F.col(expected) == e) & (F.col(observed) == o)).cast("bigint").alias(n) for n, (e, o) in pairs.items()]


def counts(rows: DataFrame, by: list[str], expected: str = "expected", observed: str = "observed", strict: bool = False) -> DataFrame:
    """TP, TN, FP and FN; abnormal is positive. Rows with other labels do not count, or are an error with strict."""
    rows = known_labels(rows, expected, observed) if strict else rows
    return rows.groupBy(*by).agg(*_cells(expected, observed))


def counts_with_failed(rows: DataFrame, by: list[str], expected: str = "expected", observed: str = "observed") -> DataFrame:
    """counts with `evaluated`, their sum, and `failed`: rows of a known expected label without a known observed one. Failed rows are in no denominator."""
    failed = F.col(expected).isin(*LABELS) & ~F.coalesce(F.col(observed).isin(*LABELS), F.lit(False))
    told = rows.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    out = told.groupBy(*by).agg(*_cells(expected, observed), F.count_if("_failed").cast("bigint").alias("failed"))
    return out.withColumn("evaluated", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def counts_by_label(rows: DataFrame, label: str, labels: list[str], expected: str = "expected", observed: str = "observed") -> DataFrame:
    """counts_with_failed of each label of a given list, in which a label without rows stays, with zeros. Labels that are not listed are left out; one listed twice counts once."""
    listed = rows.sparkSession.range(1).select(F.explode(F.lit(sorted(set(labels)))).alias(label))
    found = counts_with_failed(rows.filter(F.col(label).isin(*labels)), [label], expected, observed)
    return listed.join(found, label, "left").fillna(0, ["tp", "tn", "fp", "fn", "failed", "evaluated"])


def metrics(table: DataFrame, zero: bool = False) -> DataFrame:
    """The confusion metrics of count rows; an undefined ratio is null, or 0 with zero."""
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if zero else (lambda c: c)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda a, b: fill(F.try_divide(a, b))
    out = table.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("specificity", ratio(tn, tn + fp))
    return out.withColumn("balanced_accuracy", fill((F.col("recall") + F.col("specificity")) / 2)).withColumn("far", ratio(fn, tp + fn)).withColumn("frr", ratio(fp, tn + fp))


def unpivot_metrics(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.unpivot(keys, list(METRICS), "metric", "value")


def fold_variance(rows: DataFrame, fold: str = "source_id") -> DataFrame:
    """Mean, sample deviation, extremes and median of each metric over the folds where it is defined."""
    long = unpivot_metrics(metrics(counts(rows, [fold])), [fold])
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("largest"), F.percentile("value", 0.5).alias("median"), F.count("value").alias("valid_folds"), F.count_if(F.col("value").isNull()).alias("undefined_folds"))


def bootstrap(clusters: DataFrame, draws: DataFrame) -> DataFrame:
    """clusters: (cluster_no, tp, tn, fp, fn); draws: (rep, cluster_no, times). Metrics depend on summed counts only."""
    times = F.col("times")
    summed = draws.join(F.broadcast(clusters), "cluster_no").groupBy("rep").agg(*(F.sum(F.col(c) * times).alias(c) for c in ("tp", "tn", "fp", "fn")))
    long = unpivot_metrics(metrics(summed), ["rep"])
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("value").alias("valid"))


def hashed_draws(spark, reps: int, clusters: int, seed: int = 404) -> DataFrame:
    """Clusters drawn with replacement by SHA-256 of (seed, repetition, draw), which any engine evaluates."""
    grid = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))).alias("k"))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "rep", "k"), 256), 1, 8), 16, 10).cast("bigint")
    return grid.select("rep", F.pmod(number, F.lit(clusters)).alias("cluster_no")).groupBy("rep", "cluster_no").agg(F.count(F.lit(1)).alias("times"))


def numpy_draws(spark, reps: int, clusters: int, seed: int = 404) -> DataFrame:
    """Draws of NumPy's default generator, made on the driver: reps times clusters numbers."""
    import numpy as np

    drawn = np.random.default_rng(seed).choice(clusters, size=(reps, clusters), replace=True)
    rows = [(r, c, int((drawn[r] == c).sum())) for r in range(reps) for c in range(clusters)]
    return spark.createDataFrame([x for x in rows if x[2]], "rep long, cluster_no long, times long")


def best_parameters(scores: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of the largest balanced accuracy, then F1, of each fold; the first by `order` of equals."""
    w = Window.partitionBy(*by).orderBy(F.col("balanced_accuracy").desc_nulls_last(), F.col("f1").desc_nulls_last(), *order)
    return scores.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def main_attribution(rows: DataFrame, by: list[str], label: str = "attribution") -> DataFrame:
    """The most frequent label, the first by name of equals."""
    n = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), label)
    return n.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*by, F.col(label).alias("main_attribution"), "n")


def leakage(folds: DataFrame, group: str = "source_id", held_out: str = "held_out") -> DataFrame:
    """Training rows of each fold and those of the held-out group among them, which must be 0."""
    return folds.groupBy(held_out).agg(F.count(F.lit(1)).alias("training_rows"), F.count_if(F.col(group) == F.col(held_out)).alias("leaked_rows"))
