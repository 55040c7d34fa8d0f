import pytest
from pyspark.sql import functions as F

from windowforge.operators import evaluate as E
from windowforge.operators import splits as X
from windowforge.operators.checks import ViolationError, require_none


def samples(spark, trials):
    rows = [(f"S_{p}_{a}_R{t:03}", p, a) for p in ("P01", "P02", "P03") for a in ("sit", "walk") for t in range(trials)]
    return spark.createDataFrame(rows, "sample_id string, person_id string, action_id string")


@pytest.mark.parametrize(("trials", "sizes"), [(20, (78, 18, 24)), (5, (18, 6, 6))])
def test_split_sizes(spark, trials, sizes):
    s = samples(spark, trials)
    got = X.stratified_split(s, ["person_id", "action_id"], "sample_id", [2026, 2027])
    assert X.split_violations(got, s, ["person_id", "action_id"], "sample_id").isEmpty()
    counts = {(r.seed, r.split): r.n for r in X.split_summary(got).collect()}
    assert [counts[2026, p] for p in X.PARTS] == list(sizes)
    shuffled = X.stratified_split(s.orderBy(F.rand(1)), ["person_id", "action_id"], "sample_id", [2026, 2027])
    assert got.exceptAll(shuffled.select(got.columns)).isEmpty()
    differ = X.compare_assignments(got.where("seed = 2026"), got.where("seed = 2027").withColumn("seed", F.lit(2026)), "sample_id")
    assert differ.count() > 0


def test_small_strata_are_violations(spark):
    s = samples(spark, 2)
    bad = X.split_violations(X.stratified_split(s, ["person_id", "action_id"], "sample_id", [1]), s, ["person_id", "action_id"], "sample_id")
    with pytest.raises(ViolationError):
        require_none(bad, "bad split")


def test_loso_wraps(spark):
    got = {r.test_person: r.val_person for r in X.loso_pairs(samples(spark, 1), "person_id").collect()}
    assert got == {"P01": "P02", "P02": "P03", "P03": "P01"}


def test_metrics_by_hand(spark):
    preds = spark.createDataFrame([(1, t, p) for t, p in ((0, 0), (0, 1), (1, 1), (1, 1))], "run int, true int, pred int")
    classes = spark.createDataFrame([(0,), (1,)], "label int")
    m = E.confusion_matrix(preds, classes, ("run",))
    assert sorted((r.true, r.pred, r.n) for r in m.collect()) == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    r = E.metrics(E.class_report(m, ("run",)), ("run",)).first()
    assert r.accuracy == 0.75 and abs(r.macro_f1 - (2 / 3 + 0.8) / 2) < 1e-12
    labels = spark.createDataFrame([(x,) for x in (0, 0, 0, 1)], "label int")
    assert {r.label: round(r.weight, 6) for r in E.class_weights(labels, classes).collect()} == {0: round(2 / 3, 6), 1: 2.0}


def test_absent_class_lowers_macro_only(spark):
    preds = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "run int, true int, pred int")
    r = E.metrics(E.class_report(E.confusion_matrix(preds, spark.createDataFrame([(0,), (1,), (2,)], "label int"), ("run",)), ("run",)), ("run",)).first()
    assert r.balanced_accuracy == 1.0 and abs(r.macro_f1 - 2 / 3) < 1e-12


def test_run_summary_and_mean_confusion(spark):
    rows = [(run, t, p, n) for run, m in ((1, [[8, 2], [1, 9]]), (2, [[6, 4], [3, 7]])) for t in (0, 1) for p in (0, 1) for n in [m[t][p]]]
    m = spark.createDataFrame(rows, "run int, true int, pred int, n long")
    assert {(r.true, r.pred): round(r.share, 6) for r in E.mean_confusion(m, "run").collect()} == {(0, 0): 0.7, (0, 1): 0.3, (1, 0): 0.2, (1, 1): 0.8}
    runs = spark.createDataFrame([(1, 0.8, 0.8, 0.8, 0.8), (2, 0.6, 0.6, 0.6, 0.6)], "run int, accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double")
    asked, none = spark.createDataFrame([(1,), (2,)], "run int"), spark.createDataFrame([], "run int")
    s = {r.metric: r for r in E.summarise_runs(runs, asked, none).collect()}["accuracy"]
    assert round(s["mean"], 6) == 0.7 and round(s["std"], 6) == 0.1 and s.complete
    assert not E.summarise_runs(runs.where("run = 1"), asked, spark.createDataFrame([(2,)], "run int")).first().complete
    assert E.summarise_runs(runs, asked, none, m).count() == 4
    for bad in (m.where("run = 1"), m.where("run = 1 OR `true` = 0"), m.withColumn("n", F.when(F.col("true") == 1, 0).otherwise(F.col("n"))), m.withColumn("n", F.col("n") - 3)):
        with pytest.raises(ViolationError, match="can't be summarised"):
            E.summarise_runs(runs, asked, none, bad)
    for args in ((runs, asked.where("run = 1"), none), (runs.unionByName(runs), asked, none), (runs, asked, asked.where("run = 2"))):
        with pytest.raises(ViolationError):
            E.summarise_runs(*args)
    bad = runs.withColumn("macro_f1", F.lit(float("nan")))
    assert {r.problem for r in E.run_violations(bad, asked, none).collect()} == {"not_finite"}


def test_early_stop(spark):
    scores = [0.1, 0.5, 0.4, 0.5, 0.3, 0.9]
    h = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "run int, epoch int, score double")
    r = E.early_stop(h, 3).first()
    assert (r.best_epoch, r.best_score, r.stop_epoch) == (2, 0.5, 5)


@pytest.mark.parametrize("true, pred", [("a", "z"), ("z", "a"), (None, "a"), ("a", None)])
@pytest.mark.parametrize("runs", [(), ("run",)])
def test_labels_outside_the_classes_are_an_error(spark, true, pred, runs):
    classes = spark.createDataFrame([("a",), ("b",)], "label string")
    preds = spark.createDataFrame([(1, "a", "a"), (2, true, pred)], "run int, true string, pred string")
    with pytest.raises(Exception, match="labels outside the classes"):
        E.confusion_matrix(preds, classes, runs).collect()
    with pytest.raises(Exception, match="labels outside the classes"):
        E.metrics(E.class_report(E.confusion_matrix(preds, classes, runs), runs), runs).collect()
    assert [(r.true, r.pred) for r in E.out_of_range(preds, classes).collect()] == [(true, pred)]


def test_nothing_to_evaluate_is_an_error(spark):
    classes = spark.createDataFrame([("a",)], "label string")
    with pytest.raises(ValueError, match="no predictions"):
        E.confusion_matrix(spark.createDataFrame([], "run int, true string, pred string"), classes)


def test_split_is_that_of_a_whole_sort(spark, monkeypatch):
    """Strata of every size, null strata, a single stratum: the rows of each part as by sorting a whole stratum, for short and long prefixes."""
    import hashlib

    rows = [(f"k{i}", "one" if i < 300 else None if i < 307 else f"s{i % 40}") for i in range(700)]
    want = {}
    for seed in (1, 2):
        for stratum in {s for _, s in rows}:
            own = sorted((hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k) for k, s in rows if s == stratum)
            a = round(len(own) * 0.65)
            b = a + (len(own) - a) // 2
            want |= {(seed, k): "train" if i < a else "val" if i < b else "test" for i, (_, k) in enumerate(own)}
    df = spark.createDataFrame(rows, "k string, s string")
    for digits in (0, 1, 4):
        monkeypatch.setattr(X, "PREFIX", digits)
        got = X.stratified_split(df, ["s"], "k", [1, 2])
        assert got.columns == ["k", "s", "seed", "split"]
        assert {(r.seed, r.k): r.split for r in got.collect()} == want
