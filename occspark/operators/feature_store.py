"""Features kept in folders of year and bucket: a refresh reads and writes what it touches, a report lookup reads one folder (O-6.13, O-6.14, O-9.3 to O-9.5).

The bucket is a hash of the report number, so all features of a report, and with them every
feature key, lie in one bucket of their year. Files are sorted by report number and carry its
minima, maxima and a Bloom filter, so a lookup reads one row group or two of its folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_lookup_key
from ..sources import versions as VS
from ..sources.scratch import stored
from . import features as FE
from . import lookups as LO
from .records import KEY, source_config, source_rows

#: Buckets of a year. Choose them so that a folder holds some hundred MB.
BUCKETS = 64
#: Bytes of a row group: small, as lookups read few rows.
ROW_GROUP = 8 << 20
_BY = ["ano_bo", "bucket"]


def bucket_of(num_bo: Column, buckets: int) -> Column:
    """The bucket of a report number."""
    return F.pmod(F.xxhash64(num_bo), F.lit(buckets)).cast("int")


def _how(key: str, row_group: int = ROW_GROUP) -> dict[str, str]:
    return {"parquet.block.size": str(row_group), f"parquet.bloom.filter.enabled#{key}": "true"}


def _laid_out(features: DataFrame, buckets: int) -> DataFrame:
    # rebalanced: a folder that is too large for one task is written by several
    return features.withColumn("bucket", bucket_of(F.col("num_bo"), buckets)).hint("rebalance", *_BY).sortWithinPartitions(*_BY, *[k for k in KEY if k != "ano_bo"])


def write_features(features: DataFrame, path: str, buckets: int = BUCKETS, row_group: int = ROW_GROUP) -> int:
    """Features (merge_features, with or without derive_search_columns) instead of what the store held; gives their number."""
    spark = features.sparkSession
    before = VS.listed(spark, path)
    laid = _laid_out(features, buckets)
    parts = VS.write_parts(laid, path, _BY, tags=F.col("source_tables"), options=_how("num_bo", row_group))
    VS.publish(spark, path, before, laid.schema, parts, {"buckets": str(buckets)})
    return sum(p.rows for p in parts)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All features of the store."""
    return VS.read_parts(spark, path, VS.listed(spark, path)).drop("bucket")


def touched_parts(rows: DataFrame, table: VS.Listed, tables: list[str]) -> set[str]:
    """Names of the parts that new ``rows`` of some tables fall in, and of those that hold features these tables fed."""
    fed = {p.name for p in table.parts.values() if set(p.tags) & set(tables)}
    bucket = bucket_of(F.col("num_bo"), int(table.options["buckets"]))
    return fed | {VS.part_name(r.asDict()) for r in rows.select("ano_bo", bucket.alias("bucket")).distinct().collect()}


def refresh_store(spark: SparkSession, path: str, tables: dict[str, DataFrame], flagged: list[str]) -> dict[str, int]:
    """O-6.14 on a store: what incremental_refresh makes of all features, from the touched parts alone.

    Only folders that a flagged table fed, or feeds now, are read, merged and written, and
    they are current together or, if anything fails, not at all. Gives the rows of each part
    that was touched, 0 for one that is empty now.
    """
    known = sorted(t for t in set(flagged) & set(tables) if source_config(t) is not None)
    if not known:
        return {}
    table = VS.listed(spark, path)
    rows = stored(reduce(DataFrame.unionByName, [source_rows(tables[t], t) for t in known]), "refreshed")
    names = touched_parts(rows, table, known)
    old = VS.read_parts(spark, path, table, [p for name, p in table.parts.items() if name in names])
    merged = FE.refresh_features(old.drop("bucket"), rows, known)
    if "search_categories" in table.schema.names:
        merged = FE.derive_search_columns(merged)
    laid = _laid_out(merged, int(table.options["buckets"])).select(*table.schema.names)
    new = VS.replace_parts(laid, path, _BY, emptied=names, tags=F.col("source_tables"), options=_how("num_bo"))
    return {name: 0 for name in names} | {p.name: p.rows for p in new}


def _of_reports(spark: SparkSession, path: str, buckets_of: DataFrame) -> DataFrame:
    """The features in the parts that (bucket, ano_bo or null for all years) name; as many values as the store has parts, at most."""
    table = VS.listed(spark, path)
    wanted = {(str(r["bucket"]), None if r["ano_bo"] is None else str(r["ano_bo"])) for r in buckets_of.select("bucket", F.col("ano_bo").cast("int").alias("ano_bo")).distinct().collect()}
    parts = [p for p in table.parts.values() if wanted & {(p.values()["bucket"], None), (p.values()["bucket"], p.values()["ano_bo"])}]
    return VS.read_parts(spark, path, table, parts).drop("bucket")


def _key(spark: SparkSession, path: str, num_bo: str, ano_bo: int | None) -> DataFrame:
    number = spark.createDataFrame([(num_bo.strip(), ano_bo)], "num_bo string, ano_bo int")
    return number.select(bucket_of(F.col("num_bo"), int(VS.listed(spark, path).options["buckets"])).alias("bucket"), "ano_bo")


def stored_features_by_report(spark: SparkSession, path: str, num_bo: str, ano_bo: int | None = None, delegacia: str | None = None) -> DataFrame:
    """O-9.3 from a store: one folder for each year asked for, and of its files the row groups that may hold the number."""
    return LO.features_by_report(_of_reports(spark, path, _key(spark, path, num_bo, ano_bo)), num_bo, ano_bo, delegacia)


def stored_summaries_by_report(spark: SparkSession, path: str, num_bo: str, ano_bo: int | None = None, delegacia: str | None = None) -> DataFrame:
    """O-9.4 from a store; the thin columns alone are read."""
    return LO.summaries_by_report(_of_reports(spark, path, _key(spark, path, num_bo, ano_bo)), num_bo, ano_bo, delegacia)


def stored_features_by_reports(spark: SparkSession, path: str, reports: DataFrame) -> DataFrame:
    """O-9.3 for a table of keys: the folders that they name, then the join."""
    buckets = int(VS.listed(spark, path).options["buckets"])
    return LO.features_by_reports(_of_reports(spark, path, reports.select(bucket_of(F.col("num_bo"), buckets).alias("bucket"), "ano_bo")), reports)


def write_coroner(coroner: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Coroner rows (with id and source_table) instead of what the store held, in buckets of their normalized number; gives their number."""
    spark = coroner.sparkSession
    keyed = coroner.withColumn("_num_key", normalize_lookup_key("NUM_BO"))
    laid = keyed.withColumn("bucket", bucket_of(F.col("_num_key"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "_num_key")
    before = VS.listed(spark, path)
    parts = VS.write_parts(laid, path, ["bucket"], options=_how("_num_key"))
    VS.publish(spark, path, before, laid.schema, parts, {"buckets": str(buckets)})
    return sum(p.rows for p in parts)


def stored_feature_detail(spark: SparkSession, path: str, coroner_path: str, num_bo: str, ano_bo: int | None = None, delegacia: str | None = None) -> DataFrame:
    """O-9.5 from stores: the first feature of a report with its coroner records, of which one bucket is read."""
    table = VS.listed(spark, coroner_path)
    number = spark.createDataFrame([(num_bo.strip(),)], "num_bo string").select(normalize_lookup_key("num_bo").alias("key"))
    told = number.select("key", bucket_of(F.col("key"), int(table.options["buckets"])).alias("bucket")).first()
    rows = VS.read_parts(spark, coroner_path, table, [p for p in table.parts.values() if p.values()["bucket"] == str(told["bucket"])])
    own = rows.where(F.col("_num_key") == told["key"]).drop("_num_key", "bucket")
    return LO.coroner_join(stored_features_by_report(spark, path, num_bo, ano_bo, delegacia).limit(1), own)
