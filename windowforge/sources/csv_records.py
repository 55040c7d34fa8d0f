"""Records of CSV files that are read in splits, although a quoted field may hold line breaks.

Whether a line begins inside a quoted field hangs on all lines before it. A line is therefore a function of that state: it ends inside or outside if
it began outside, and inside or outside if it began inside. Only lines with a quote can change it. Their functions, without any text, are composed along each
split, the splits' along each file; what comes of it are the runs of lines that make up records of several lines. Lines outside of such runs are records by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.sources.scratch import staged

# a quoted field's inside; a field and what follows a closing quote up to the comma; possessive, so that nothing is tried twice
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
#: Lines that end inside a quoted field: of those that begin outside of one, and of those that begin inside.
_OPENS = rf'^\uFEFF?{_FIELDS}"{_INSIDE}\z'
_STAYS = rf'^{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?+\z'


def _with_states(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds in_out and in_in: whether a row begins inside if the first row of its group began outside, or inside. Rows have functions (from_out, from_in).

    A row either sets the state, whatever it was, or keeps it, or turns it: the state is that of the last row that set it, turned as often as rows have turned it since.
    """
    run = Window.partitionBy(*keys).orderBy(at)
    sets, turns = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    df = df.withColumn("_turned", F.sum(turns.cast("long")).over(run))
    df = df.withColumn("_set", F.last(F.when(sets, F.struct(F.col("from_out").alias("to"), "_turned")), ignorenulls=True).over(run))
    df = df.withColumn("_turned", F.coalesce(F.lag("_turned").over(run), F.lit(0))).withColumn("_set", F.lag("_set").over(run))
    odd = (F.col("_turned") - F.coalesce("_set._turned", F.lit(0))) % 2 == 1
    begin = lambda first: F.coalesce("_set.to", F.lit(first)) != odd
    return df.withColumn("in_out", begin(False)).withColumn("in_in", begin(True)).drop("_turned", "_set")


def _end(begin: Column | str) -> Column:
    return F.when(F.col(begin) if isinstance(begin, str) else begin, F.col("from_in")).otherwise(F.col("from_out"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(place, record): the text of every record of the files at a path, without headers and blank lines; places order the records of a file.

    Lines end with ``\\n`` or ``\\r\\n``. A quote opens a field only where a field begins, a doubled one is a character; a quote that is never closed runs to the file's end.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    # Spark cuts splits by the cores that are there: numbered lines are written, so that a lost executor can't renumber them between two reads
    lines = staged(lines)
    bounds = lines.groupBy("path", "split").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    quoted = lines.where(F.col("value").contains('"')).select("path", "split", "line", F.col("value").rlike(_OPENS).alias("from_out"), F.col("value").rlike(_STAYS).alias("from_in"))
    quoted = _with_states(quoted, ["path", "split"], "line")
    begun = lambda c: F.max(F.when(~F.col(c), F.col("line")))
    pieces = quoted.groupBy("path", "split").agg(
        F.max_by(_end("in_out"), "line").alias("from_out"), F.max_by(_end("in_in"), "line").alias("from_in"), begun("in_out").alias("opened_out"), begun("in_in").alias("opened_in")
    )
    pieces = bounds.join(pieces, ["path", "split"], "left").withColumns({"from_out": F.coalesce("from_out", F.lit(False)), "from_in": F.coalesce("from_in", F.lit(True))})
    pieces = _with_states(pieces, ["path"], "split")  # a row for each split of a file
    # if a split ends inside, its last line with a quote that began outside is the one that opened
    pieces = pieces.withColumn("opened", F.when(F.col("in_out"), F.col("opened_in")).otherwise(F.col("opened_out")))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("path", "split", "first", "last", F.col("in_out").alias("inside"), _end("in_out").alias("open"), "opened", F.last("opened", ignorenulls=True).over(before).alias("carried"))
    turns = quoted.join(pieces.select("path", "split", "first", "carried", "inside"), ["path", "split"])
    turns = turns.withColumn("inside", F.when(F.col("inside"), F.col("in_in")).otherwise(F.col("in_out"))).withColumn("open", _end("inside")).where("inside <> open")
    opener = F.lag("line").over(Window.partitionBy("path", "split").orderBy("line"))
    closed = turns.withColumn("opener", opener).where("inside").select(F.coalesce("opener", "first").alias("from"), F.col("line").alias("to"), F.coalesce("opener", "carried").alias("start"))
    left = pieces.where("open").select(F.coalesce("opened", "first").alias("from"), F.col("last").alias("to"), F.coalesce("opened", "carried").alias("start"))
    several = closed.unionByName(left).select("start", F.explode(F.sequence("from", "to")).alias("line"), F.lit(False).alias("header"))
    headers = pieces.where("split = 0").select(F.col("first").alias("start"), F.col("first").alias("line"), F.lit(True).alias("header"))
    # written, so that the planner knows its size: the text is moved only where these lines are many
    marked = staged(several.unionByName(headers).groupBy("line").agg(F.max("start").alias("start"), F.max("header").alias("header")))
    alone = lines.join(marked, "line", "left_anti").select(F.struct("path", F.col("line").alias("start")).alias("place"), F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("split", "line", "value")))
    joined = lines.join(marked, "line").groupBy("path", "start").agg(parts.alias("parts"), F.max("header").alias("header")).where("NOT header")
    joined = joined.select(F.struct("path", "start").alias("place"), F.array_join("parts.value", "\n").alias("record"))
    return alone.unionByName(joined).where("record NOT IN ('', '\r')")


def read_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """All columns as strings, named by the header; with ``place`` also a column of that name that orders the rows of a file."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    # a record's last line may end with a carriage return
    cells = F.from_csv(F.regexp_replace("record", r"\r\z", ""), _ddl(names), {"escape": '"'})
    rows = csv_records(spark, path).select(cells.alias("_cells"), "place")
    return rows.select("_cells.*", *([F.col("place").alias(place)] if place else []))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
