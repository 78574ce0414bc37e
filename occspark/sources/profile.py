"""Column profiles and type inference (O-5.*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import values as V
from ..functions.text import normalize_column_name
from .schema import drop_identical_duplicate_columns

#: What a number may look like: sign, digits with a point, exponent, or inf and nan.
FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
#: Distinct values are counted up to this.
MOST_UNIQUE = 1000
_STATS = ("null_count", "total_count", "min_length", "max_length", "unique_count", "numeric_min", "numeric_max", "all_numeric", "all_integer", "all_date", "all_time", "all_timestamp", "any_zip")


def _stats(c: str) -> Column:
    v = F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    absent = (v == "") | P.is_null_pattern(v)
    own = F.when(~absent, v)
    number = F.when(own.rlike(FLOAT), own.try_cast("double"))
    numeric = F.bool_and(own.rlike(FLOAT))
    whole = own.rlike(FLOAT) & ~F.isnan(number) & (F.abs(number) < float("inf")) & (number == F.floor(number))
    finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    values = (F.count_if(absent), F.count(F.lit(1)), F.min(F.octet_length(own)), F.max(F.octet_length(own)), F.least(F.approx_count_distinct(own, 0.02), F.lit(MOST_UNIQUE)),
              F.when(numeric, F.min(finite)), F.when(numeric, F.max(finite)), numeric, F.bool_and(whole), F.bool_and(V.is_date_format(own)), F.bool_and(V.is_time_format(own)), F.bool_and(V.is_timestamp_format(own)), F.coalesce(F.bool_or(P.is_zip_code(own)), F.lit(False)))
    return F.struct(F.lit(c).alias("column"), *[x.alias(n) for x, n in zip(values, _STATS, strict=True)])


def profile_columns(df: DataFrame) -> DataFrame:
    """O-5.1, O-5.2, O-5.3: one row for each column, from one aggregation over all rows.

    No value is shuffled: tasks send one partial result each. unique_count is approximate
    (2 %) and capped. The flags are NULL for a column without values.
    """
    one = df.agg(F.array(*[_stats(c) for c in df.columns]).alias("profile"))
    return one.select(F.inline("profile"))


#: Bits of a sketch's number of registers; the estimate is off by 0.8 %, about.
SKETCH_BITS = 14
_STATE = ("null_count", "total_count", "min_length", "max_length", "numeric_min", "numeric_max", "all_numeric", "all_integer", "all_date", "all_time", "all_timestamp", "any_zip", "sketch")


def _state(c: str) -> Column:
    """What is known of a column over some rows, so that two of them can be added up."""
    v = F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    absent = (v == "") | P.is_null_pattern(v)
    own = F.when(~absent, v)
    number = F.when(own.rlike(FLOAT), own.try_cast("double"))
    whole = own.rlike(FLOAT) & ~F.isnan(number) & (F.abs(number) < float("inf")) & (number == F.floor(number))
    finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    values = (F.count_if(absent), F.count(F.lit(1)), F.min(F.octet_length(own)), F.max(F.octet_length(own)), F.min(finite), F.max(finite), F.bool_and(own.rlike(FLOAT)), F.bool_and(whole), F.bool_and(V.is_date_format(own)), F.bool_and(V.is_time_format(own)),
              F.bool_and(V.is_timestamp_format(own)), F.coalesce(F.bool_or(P.is_zip_code(own)), F.lit(False)), F.hll_sketch_agg(own, SKETCH_BITS))
    return F.struct(F.lit(c).alias("column"), *[x.alias(n) for x, n in zip(values, _STATE, strict=True)])


def profile_states(df: DataFrame, file: Column) -> DataFrame:
    """O-5.1 for each file by itself: (file, column, counts, bounds, flags, sketch of the values).

    ``file`` names a row's file (``_metadata.file_path`` of files that Spark reads). Tasks send
    one partial result a file and column. :func:`merge_states` adds them up.
    """
    named = df.select(*[F.col(f"`{c}`") for c in df.columns], file.alias("_file"))
    return named.groupBy("_file").agg(F.array(*[_state(c) for c in df.columns]).alias("states")).select(F.col("_file").alias("file"), F.inline("states"))


def merge_states(states: DataFrame) -> DataFrame:
    """The profile (as profile_columns gives it) of all files that ``states`` tells of; unique_count within 2 %, capped."""
    flags = ("all_numeric", "all_integer", "all_date", "all_time", "all_timestamp")
    met = states.groupBy("column").agg(
        F.sum("null_count").alias("null_count"), F.sum("total_count").alias("total_count"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.min("numeric_min").alias("least"), F.max("numeric_max").alias("most"),
        *[F.bool_and(f).alias(f) for f in flags], F.bool_or("any_zip").alias("any_zip"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("found"))
    return met.withColumns({"numeric_min": F.when(F.col("all_numeric"), F.col("least")), "numeric_max": F.when(F.col("all_numeric"), F.col("most")), "unique_count": F.least("found", F.lit(MOST_UNIQUE))}).select("column", *_STATS)


def refresh_states(states: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """``states`` without those of the files in ``gone`` (file), and with ``fresh`` ones: those of files that changed, of new ones.

    Only changed files (O-11.5) are profiled again; a file in ``fresh`` counts as gone before.
    """
    away = gone.select("file").unionByName(fresh.select("file")).distinct().withColumnRenamed("file", "_gone")
    return states.join(away, F.col("file") == F.col("_gone"), "left_anti").unionByName(fresh)


def infer_type(profile: DataFrame) -> DataFrame:
    """O-5.4: the profile with an ``inferred_type``."""
    name = F.lower("column")
    values = F.col("total_count") - F.col("null_count")
    small = (F.col("numeric_min") >= 0) & (F.col("numeric_max") <= 10000) & (values >= 20) & (F.col("total_count") < 100_000)
    within = (F.col("numeric_min") >= -(2.0**31)) & (F.col("numeric_max") <= 2.0**31 - 1)
    kind = (F.when(values == 0, "TEXT").when(name.rlike("cep|zip|postal") | F.col("any_zip"), "TEXT").when(F.col("all_timestamp"), "TIMESTAMP").when(F.col("all_date"), "DATE").when(F.col("all_time"), "TIME")
            .when(F.col("all_integer") & small, "SMALLINT").when(F.col("all_integer") & within, "INT").when(F.col("all_integer"), "BIGINT").when(F.col("all_numeric"), "NUMERIC").otherwise("TEXT"))
    return profile.withColumn("inferred_type", kind)


def correct_type(name: str, kind: str, value: Column) -> Column:
    """O-5.5: the type that a cell is cleaned by, as text: TIME columns that hold descriptions are TEXT."""
    own = normalize_column_name(name)
    if kind.upper() != "TIME":
        return F.lit(kind)
    if own in ("DESCR_PERIODO", "DESC_PERIODO") or not any(x in own for x in ("HORA", "TIME", "HORARIO")):
        return F.lit("TEXT")
    if any(x in own for x in ("DESCR", "DESC", "PERIODO", "TIPO")):
        return F.lit("TEXT")
    return F.when(P.is_descriptive_text(value), "TEXT").otherwise("TIME")


def prepare_table(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, Observation]:
    """O-5.6: every cell cleaned by its type; the observation tells ``changed`` cells once the rows are read."""
    unique = drop_identical_duplicate_columns(df)
    by_name = {normalize_column_name(k): v for k, v in types.items()}
    raws, cells, changed = [], [], F.lit(0)
    for k, c in enumerate(unique.columns):
        raw, kind = F.coalesce(F.col(c).cast("string"), F.lit("")), by_name.get(c, "TEXT")
        clean = V.clean_by_type(raw, kind, c)
        if kind.upper() == "TIME":
            clean = F.when(correct_type(c, kind, raw) == "TIME", clean).otherwise(V.clean_general(raw))
        raws.append(raw.alias(f"_raw_{k}"))
        cells.append(clean.alias(f"_cell_{k}"))
        changed = changed + (F.col(f"_cell_{k}") != F.col(f"_raw_{k}")).cast("int")
    seen = Observation()
    both = unique.select(*raws, *cells).withColumn("_changed", changed)  # cleaned once, then compared
    told = both.observe(seen, F.sum("_changed").alias("changed"), F.count(F.lit(1)).alias("rows"))
    return told.select(*[F.col(f"_cell_{k}").alias(c) for k, c in enumerate(unique.columns)]), seen
