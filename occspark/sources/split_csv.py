"""One large CSV file read by many tasks (O-1.1).

A line break within quotes is no end of a row, so a split of a file can't tell by itself
where its rows begin. Here lines are read in parallel; each tells, for both cases, whether
its end is within quotes if its start is. These answers are put together in order within a
split, then over the splits (one row each), which tells every line its state and its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# What follows an opening quote, up to the quote that closes it: pairs of quotes stay within.
_QUOTED = '[^"]*+(?:""[^"]*+)*+'
# From a cell's start on: cells that end in this line, then one that doesn't.
_OPENS = f'(?:(?:"{_QUOTED}"[^;]*+|[^";][^;]*+)?+;)*+"{_QUOTED}\\z'
#: A line that starts outside of quotes and ends within, and one that starts and ends within.
_FROM_OUTSIDE, _FROM_WITHIN = f"\\A{_OPENS}", f'\\A{_QUOTED}(?:\\z|"[^;]*+;{_OPENS})'


def _settled(start: Column, fixed: Column, flips: Column) -> Column:
    """The state that a run of lines ends in: `fixed` if one of them left no choice, else that of its start; turned at every flip since."""
    return F.coalesce(fixed, start) != (flips % 2 == 1)


def _run(df: DataFrame, order: WindowSpec, out: Column, within: Column) -> DataFrame:
    """(fixed, flips) up to and with each row: the end state of the last one that left no choice, and the turns since."""
    df = df.withColumn("_turns", F.sum((out & ~within).cast("long")).over(order))
    free = out != within
    return (df.withColumn("fixed", F.last(F.when(~free, out), ignorenulls=True).over(order))
            .withColumn("flips", F.col("_turns") - F.coalesce(F.last(F.when(~free, F.col("_turns")), ignorenulls=True).over(order), F.lit(0))))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the text of every row of CSV files, `first` for that of a file's header.

    Lines end with \\n, or \\r\\n if a file's first one does; then that is \\n within cells, too. Empty lines between rows are left out, those within quotes stay.
    The lines are shuffled by split; those of rows of several lines once more, by row.
    A quote that nothing closes makes the rest of its file one row, which is one task's.
    """
    raw = spark.read.text(path, lineSep="\n")
    value, plain = F.col("value"), ~F.contains("value", F.lit('"'))
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
                       F.when(plain, False).otherwise(value.rlike(_FROM_OUTSIDE)).alias("out"), F.when(plain, True).otherwise(value.rlike(_FROM_WITHIN)).alias("within"))
    # in a split all rows come from one task, in the file's order
    split, order = Window.partitionBy("file", "block").orderBy("id"), Window.partitionBy("file").orderBy("block")
    lines = _run(lines, split, F.col("out"), F.col("within"))
    before = lambda start: _settled(start, F.lag("fixed").over(split), F.lag("flips", 1, 0).over(split))

    # what each split says of its end and of the last row that begins in it, for both states of its start
    told = lines.select("file", "block", "id", "fixed", "flips", (~value.isin("", "\r")).alias("told"), value.endswith("\r").alias("cr"), before(F.lit(False)).alias("before_out"), before(F.lit(True)).alias("before_in"))
    ends = told.groupBy("file", "block").agg(F.max_by(F.struct("fixed", "flips"), "id").alias("end"), F.min(F.when(F.col("told"), F.col("id"))).alias("first"), F.min_by("cr", "id").alias("cr"),
                                             F.max(F.when(~F.col("before_out"), F.col("id"))).alias("begun_out"), F.max(F.when(~F.col("before_in"), F.col("id"))).alias("begun_in"))
    both = [_settled(F.lit(start), F.col("end.fixed"), F.col("end.flips")).alias(name) for start, name in ((False, "out"), (True, "within"))]
    splits = _run(ends.select("*", *both), order, F.col("out"), F.col("within"))
    file = Window.partitionBy("file")
    splits = splits.select("file", "block", F.coalesce(F.lag(_settled(F.lit(False), F.col("fixed"), F.col("flips"))).over(order), F.lit(False)).alias("start"), "begun_out", "begun_in",
                           F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).over(file).alias("header"), F.min_by("cr", "block").over(file).alias("cr"))
    begun = F.when(F.col("start"), F.col("begun_in")).otherwise(F.col("begun_out"))
    carried = F.last(F.when(begun.isNotNull(), F.struct("block", begun.alias("begin"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "start", "header", "cr", carried.alias("carried"))

    known = lines.join(splits, ["file", "block"]).withColumns({"before": before(F.col("start")), "after": _settled(F.col("start"), F.col("fixed"), F.col("flips"))})
    is_first = (F.col("block") == F.col("header.block")) & (F.col("id") == F.col("header.first"))
    known = known.select("file", "block", "id", "value", "cr", "before", "after", is_first.alias("first"), "carried", F.last(F.when(~F.col("before"), F.col("id")), ignorenulls=True).over(split).alias("begin"))
    whole = known.where(~F.col("before") & ~F.col("after")).select("file", "cr", "first", value.alias("record"))
    row = F.when(F.col("begin").isNotNull(), F.struct("block", "begin")).otherwise(F.col("carried"))
    rows = known.where(F.col("before") | F.col("after")).groupBy("file", "cr", row.alias("row")).agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("of"), F.bool_or("first").alias("first"))
    joined = rows.select("file", "cr", "first", F.array_join(F.transform("of", lambda x: x["value"]), "\n").alias("record"))
    record = F.when(F.col("cr"), F.regexp_replace("record", "\r(?=\n|\\z)", "")).otherwise(F.col("record"))
    return whole.unionByName(joined).select("file", "first", record.alias("record")).where(F.col("record") != "")


def split_rows(spark: SparkSession, path: str, names: list[str], options: dict[str, object], strict: bool) -> DataFrame:
    """The rows of CSV files with a header, by position as columns _c0, _c1 and so on; ragged ones are dropped, or fail if ``strict``."""
    fields = [f"_c{k} STRING" for k in range(len(names))]
    told = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()} | {"lineSep": "\n"}
    if strict:
        told |= {"mode": "FAILFAST"}
    else:
        fields.append("_ragged STRING")
        told |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ragged"}
    rows = csv_records(spark, path).where(~F.col("first")).select(F.from_csv("record", ", ".join(fields), told).alias("r"))
    kept = rows if strict else rows.where("r._ragged IS NULL")
    return kept.select(*[F.col(f"r._c{k}") for k in range(len(names))])
