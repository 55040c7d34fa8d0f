"""CSV files read in splits against Python's own reader, with quoted line breaks across the edges of splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from windowforge.sources import readers as R
from windowforge.sources.csv_records import csv_records, read_csv

CELLS = ["", "a", "b c", 'x"y', '"', '""', "line\nbreak", "\n", '\n\n"q",', "crlf\r\nz", "a,b", ' "lead', 'é,\n"', "plain", '"\n"', ",\n,"]
SPLITS = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def splits(spark):
    before = {k: spark.conf.get(k) for k in (SPLITS, OPEN_COST)}
    spark.conf.set(OPEN_COST, "0")
    yield lambda size: spark.conf.set(SPLITS, size)
    for k, v in before.items():
        spark.conf.set(k, v)


def written(path, n, end="\n", seed=5, head=("id", 'a "b"\nc', "x,y")):
    rng = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(head)
        w.writerows([i, rng.choice(CELLS), rng.choice(CELLS)] for i in range(n))
    with open(path, newline="", encoding="utf-8") as f:
        return [tuple(v or None for v in row) for row in csv.reader(f)][1:]


@pytest.mark.parametrize("size", ["128m", "1500", "150"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_whole_files(spark, tmp_path, splits, size, end):
    """Lines of every kind lie across the edges; with 150 bytes many a split lies wholly within a quoted field."""
    want = written(tmp_path / "a.csv", 120, end) + written(tmp_path / "b.csv", 60, end, 6)
    splits(size)
    if size != "128m":
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 3
    got = read_csv(spark, str(tmp_path), "at")
    assert got.columns == ["id", 'a "b"\nc', "x,y", "at"]
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, want))
    ids = [int(r.id) for r in got.where(F.col("at.path").endswith("a.csv")).orderBy("at").select("id").collect()]
    assert ids == list(range(120))


def test_numbers_stay_when_splits_change(spark, tmp_path, splits):
    """Splits that are cut otherwise after the plan was made, as when executors come or go, change nothing."""
    want = written(tmp_path / "a.csv", 100)
    splits("300")
    df = read_csv(spark, str(tmp_path))
    splits("1100")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_one_long_field(spark, tmp_path, splits):
    """A field of many splits, which the splits after it have to know of; blank lines within it stay, those between records go."""
    text = "\n".join(f"{i},x" for i in range(200)) + "\n\n,"
    with open(tmp_path / "a.csv", "w", newline="") as f:
        f.write(f'k,v\n1,a\n\n2,"{text}"\n3,b\n')
    splits("200")
    assert {(r.k, r.v) for r in read_csv(spark, str(tmp_path)).collect()} == {("1", "a"), ("2", text), ("3", "b")}


@pytest.mark.parametrize("text", ["k,v\n", "k,v", 'k,v\n1,"never closed\n2,b\n', 'k,v\n1,in"side\n2,b\n', "k\n\n\n", "\ufeffk,v\n1,a\n"])
def test_edges(spark, tmp_path, text):
    """Header alone, a quote that is never closed, a quote within a field, blank lines, a mark of byte order."""
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    records = [r.record for r in csv_records(spark, str(tmp_path)).orderBy("place").collect()]
    want = {'k,v\n1,"never closed\n2,b\n': ['1,"never closed\n2,b'], 'k,v\n1,in"side\n2,b\n': ['1,in"side', "2,b"], "\ufeffk,v\n1,a\n": ["1,a"]}
    assert records == want.get(text, [])


def test_text_stays_where_it_is_read(spark, tmp_path):
    """With few records of several lines, only these are moved; no window runs over texts."""
    written(tmp_path / "a.csv", 50)
    df = R.read_index(spark, str(tmp_path))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 0 and plan.count(" Exchange ") == 1  # the numbered lines are read, not the source
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_many_records_of_several_lines(spark, tmp_path):
    """The same rows where the table of marked lines is too large to be sent to all tasks."""
    want = written(tmp_path / "a.csv", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in read_csv(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_counts_come_with_the_one_pass(spark, tmp_path):
    (tmp_path / "sl.csv").write_text("sample_id,video_out_path\na,v\n,v\nb,\n")
    kept, dropped = R.load_slice_index(spark, str(tmp_path / "sl.csv"))
    (tmp_path / "sl.csv").unlink()  # nothing reads it again
    assert [r.sample_id for r in kept.collect()] == ["a"] and dropped.first().dropped == 2
