"""Classification results: confusion counts, metrics per class and run, summaries over runs, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowforge.operators.checks import ViolationError, require_none


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_weights(labels: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """classes (label) with N / (C * n); a class without rows has a null weight, which ``require_none`` can refuse."""
    counts = classes.join(labels.groupBy(label).agg(F.count("*").alias("n")), label, "left")
    every = Window.partitionBy()  # as many rows as classes
    return counts.select(label, F.coalesce("n", F.lit(0)).alias("n"), (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def confusion_matrix(predictions: DataFrame, classes: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """Dense counts (runs…, true, pred, n) of predictions (runs…, true, pred) over all pairs of ``classes`` (label).

    No predictions, or a label that is null or none of the classes, are an error; ``out_of_range`` lists the latter."""
    if predictions.isEmpty():
        raise ViolationError("no predictions to evaluate")
    counts = predictions.groupBy(*runs, "true", "pred").agg(F.count("*").alias("n"))
    grid = classes.select(F.col("label").alias("true")).join(classes.select(F.col("label").alias("pred")), F.lit(True))  # all pairs of classes are the result
    if runs:
        grid = predictions.select(*runs).distinct().join(grid, F.lit(True))
    both = grid.withColumn("_known", F.lit(True)).join(counts, [*runs, "true", "pred"], "full_outer")
    bad = F.raise_error(F.concat(F.lit("labels outside the classes: true "), F.coalesce(F.col("true").cast("string"), F.lit("null")), F.lit(", predicted "), F.coalesce(F.col("pred").cast("string"), F.lit("null"))))
    return both.withColumn("n", F.when(F.col("_known").isNull(), bad.cast("long")).otherwise(F.coalesce("n", F.lit(0)))).drop("_known")


def out_of_range(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Predictions whose true label is null or none of the classes, and those whose predicted one is."""
    known = classes.select("label")
    bad = lambda c: predictions.join(known.withColumnRenamed("label", c), c, "left_anti").select(*predictions.columns)
    return bad("true").unionByName(bad("pred"))


def class_report(confusion: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """runs…, label, support, predicted, precision, recall, f1; 0 for 0 / 0."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    rows = confusion.select(*runs, F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("r"))
    s = rows.groupBy(*runs, "r.label").agg(*[F.sum(f"r.{c}").alias(c) for c in ("support", "predicted", "hit")])
    s = s.withColumn("precision", _ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", _ratio(F.col("hit"), F.col("support")))
    return s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics(report: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, balanced accuracy over present classes, macro F1 over all classes, weighted F1 and support, per run."""
    total = F.sum("support")
    return report.groupBy(*runs).agg(
        _ratio(F.sum("hit"), total).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
        total.alias("support"),
    )


def normalised(confusion: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """Adds share of the row, 0 for an empty row."""
    return confusion.withColumn("share", _ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*runs, "true"))))


def mean_confusion(confusion: DataFrame, run: str) -> DataFrame:
    return normalised(confusion, (run,)).groupBy("true", "pred").agg(F.avg("share").alias("share"))


METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


def run_violations(runs: DataFrame, requested: DataFrame, failed: DataFrame) -> DataFrame:
    """(run, problem): twice, not requested, both completed and failed, or a metric that isn't finite."""
    say = lambda df, p: df.select("run", F.lit(p).alias("problem"))
    twice = lambda df: df.groupBy("run").count().where("count > 1")
    finite = F.lit(True)
    for m in METRICS:
        finite = finite & F.coalesce(~F.isnan(m) & (F.abs(m) < float("inf")), F.lit(False))
    out = say(twice(runs), "completed_twice").unionByName(say(twice(requested), "requested_twice")).unionByName(say(twice(failed), "failed_twice"))
    stray = runs.select("run").unionByName(failed.select("run")).join(requested.select("run"), "run", "left_anti")
    return out.unionByName(say(stray, "not_requested")).unionByName(say(runs.join(failed.select("run"), "run", "left_semi"), "completed_and_failed")).unionByName(say(runs.where(~finite), "not_finite"))


def matrix_violations(confusion: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, problem) of counts (run, true, pred, n): a run without a matrix, one that isn't square over the same classes as all, a negative count, a true class without rows."""
    per = confusion.groupBy("run", "true").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.count_distinct("pred").alias("d"), F.min("n").alias("least"), F.count_if(F.col("n").isNull()).alias("none"))
    classes = confusion.agg(F.count_distinct("true").alias("c"))  # one row
    shape = per.groupBy("run").agg(F.count("*").alias("rows"), F.min("d").alias("lo"), F.max("k").alias("hi"), F.min("least").alias("least"), F.min("n").alias("support"), F.max("none").alias("none"))
    shape = runs.select("run").distinct().join(shape, "run", "left").join(classes, F.lit(True))
    square = (F.col("rows") == F.col("c")) & (F.col("lo") == F.col("c")) & (F.col("hi") == F.col("c"))
    problem = F.when(F.col("rows").isNull(), "no_matrix").when(~square, "matrix_shape").when((F.col("none") > 0) | (F.col("least") < 0), "invalid_matrix").when(F.col("support") <= 0, "empty_true_class")
    return shape.select("run", problem.alias("problem")).where("problem IS NOT NULL")


def summarise_runs(runs: DataFrame, requested: DataFrame, failed: DataFrame, confusion: DataFrame | None = None) -> DataFrame:
    """(metric, mean, std of the population, min, max, n_runs, complete): complete iff every requested run is there and none failed.

    ``run_violations`` are an error, as are those of the runs' matrices (``confusion``), if given, and a request of no runs."""
    if requested.isEmpty():
        raise ViolationError("no runs were requested")
    found = run_violations(runs, requested, failed)
    require_none(found if confusion is None else found.unionByName(matrix_violations(confusion, runs)), "runs can't be summarised")
    long = runs.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*METRICS))).alias("metric", "v"))
    stats = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n_runs"))
    open_ = requested.select("run").join(runs.select("run"), "run", "left_anti").unionByName(failed.select("run"))
    return stats.join(open_.agg((F.count("*") == 0).alias("complete")), F.lit(True))  # one row


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """history (run, epoch, score) to run, best_epoch, best_score, stop_epoch: training stops at the first epoch ``patience`` after the last best
    one; an epoch is best if its score is greater than all before."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("_best", F.when(before.isNull() | (F.col("score") > before), F.col("epoch")))
    h = h.withColumn("_last", F.last("_best", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("epoch") - F.col("_last") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    h = h.withColumn("_stop", F.coalesce(stop, F.max("epoch").over(Window.partitionBy("run")))).where("epoch <= _stop AND _best IS NOT NULL")
    return h.groupBy("run").agg(F.max("_best").alias("best_epoch"), F.max_by("score", "epoch").alias("best_score"), F.first("_stop").alias("stop_epoch"))
