"""Import bookkeeping as table jobs (O-11.*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Months before now that are fetched anew each time.
RECENT_MONTHS = 3
FIRST_MONTH = "2013-01-01"


def import_status(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """O-11.1: catalog (category, year) with ``exists`` and ``rows`` from counts (category, year, rows)."""
    return catalog.join(counts, ["category", "year"], "left").withColumn("exists", F.col("rows").isNotNull()).withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))


def import_statistics(status: DataFrame) -> DataFrame:
    """O-11.2: one row: categories and tables, in all and with data, and records."""
    full = F.col("exists") & (F.col("rows") > 0)
    return status.agg(F.count_distinct("category").alias("total_categories"), F.count_distinct(F.when(full, F.col("category"))).alias("categories_with_data"), F.count(F.lit(1)).alias("total_tables"), F.count_if(full).alias("tables_with_data"), F.coalesce(F.sum(F.when(full, F.col("rows"))), F.lit(0)).cast("long").alias("total_records"))


def tables_needing_attention(status: DataFrame) -> DataFrame:
    """O-11.3: (category, year, problem) of missing and empty tables."""
    return status.where("rows = 0").select("category", "year", F.when(F.col("exists"), "empty").otherwise("missing").alias("problem"))


def import_decisions(status: DataFrame, stored: DataFrame, fresh: DataFrame, today: str) -> DataFrame:
    """O-11.4: (category, year, import, reason). stored and fresh: (category, year, file_hash); a fresh hash can be missing."""
    told = status.join(stored.withColumnRenamed("file_hash", "old"), ["category", "year"], "left").join(fresh.withColumnRenamed("file_hash", "new"), ["category", "year"], "left")
    now = F.lit(today).cast("date")
    year, differs = F.col("year"), ~F.col("old").eqNullSafe(F.col("new"))
    recheck = (year == F.year(now) - 1) & (F.month(now) <= 2) & F.col("old").isNotNull()
    reason = (F.when(~F.col("exists"), "missing").when(F.col("rows") == 0, "empty").when(~((year == F.year(now)) | recheck), F.when(year > F.year(now), "future").otherwise("past"))
              .when(F.col("new").isNull(), "unavailable").when(differs, "changed").otherwise("unchanged"))
    return told.select("category", "year", reason.isin("missing", "empty", "changed").alias("import"), reason.alias("reason"))


def changed_files(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """O-11.5: fresh files without a stored hash, or with another."""
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("file_hash").alias("_hash"))
    same = None
    for k in key:
        test = F.col(k) == F.col(f"_{k}")
        same = test if same is None else same & test
    return fresh.join(old, same & (F.col("file_hash") == F.col("_hash")), "left_anti")


def coroner_month_targets(calendar: DataFrame, imported: DataFrame, metadata: DataFrame, force: bool = False) -> DataFrame:
    """O-11.6: (year, month, reason) to fetch. calendar: one row, ``now`` as a date in Sao Paulo; others: (year, month)."""
    last = F.trunc("now", "MM")
    months = calendar.select(F.explode(F.sequence(F.lit(FIRST_MONTH).cast("date"), last, F.expr("interval 1 month"))).alias("at"), last.alias("last"))
    rows = months.select(F.year("at").alias("year"), F.month("at").alias("month"), (F.col("at") > F.add_months("last", -RECENT_MONTHS)).alias("recent"))
    mark = lambda df, name: df.select("year", "month").distinct().withColumn(name, F.lit(True))
    told = rows.join(mark(imported, "has_data"), ["year", "month"], "left").join(mark(metadata, "has_file"), ["year", "month"], "left")
    reason = F.when(F.lit(force), "forced").when(F.col("has_data").isNull(), "no data").when(F.col("has_file").isNull(), "no file").when(F.col("recent"), "recent")
    return told.select("year", "month", reason.alias("reason")).where("reason is not null")


def imported_months(table: DataFrame) -> DataFrame:
    """O-11.7: distinct (year, month) with a month from 1 to 12."""
    number = lambda c: F.when(F.trim(c).rlike("^[0-9]{1,4}$"), F.trim(c).cast("int"))
    return table.select(number("ANO_REFERENCIA").alias("year"), number("MES_REFERENCIA").alias("month")).where("year is not null and month between 1 and 12").distinct()


def group_targets_by_file(targets: DataFrame) -> DataFrame:
    """O-11.8: (url, year, categories) by file: most categories first, then newest year, then url."""
    grouped = targets.groupBy("url").agg(F.max("year").alias("year"), F.array_sort(F.collect_set("category")).alias("categories"))
    return grouped.orderBy(F.desc(F.size("categories")), F.desc("year"), "url")


def stale_files(files: DataFrame, days: int, now: str) -> DataFrame:
    """O-11.9: files that were last downloaded more than so many days ago, or never."""
    return files.where(F.col("last_downloaded").isNull() | (F.col("last_downloaded") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))))


def coroner_month_decision(targets: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """O-11.10: (year, month, action): error for an export without rows, unchanged, or replace. fresh: (year, month, file_hash, rows, present)."""
    told = targets.join(fresh, ["year", "month"]).join(stored.withColumnRenamed("file_hash", "old"), ["year", "month"], "left")
    action = F.when(F.col("rows") == 0, "error").when((F.col("file_hash") == F.col("old")) & F.col("present"), "unchanged").otherwise("replace")
    return told.select("year", "month", action.alias("action"))


def upsert_file_metadata(files: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """O-11.11: the newest row of each key; a row of ``new`` is newer than any of ``files``."""
    both = files.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_v")]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_v", *rest)).alias("_x")).select(*key, "_x.*")


def flag_tables_for_etl(status: DataFrame, tables: list[str], needed: bool = True) -> DataFrame:
    """O-11.12: sets or clears needs_geom_update of some tables."""
    return status.withColumn("needs_geom_update", F.when(F.col("source_table").isin(tables), needed).otherwise(F.col("needs_geom_update")))
