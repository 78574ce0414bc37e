"""Map features: grouping, merging, refreshing and what is derived from them (O-6.9 to O-6.19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..functions import values as V
from .records import KEY, LOCATION, OCCURRENCE, source_config, source_rows

_SUMMARY = (("celulares_count", "celular"), ("veiculos_count", "veiculo"), ("objetos_count", "objeto"), ("dados_criminais_count", "dados_criminais"))


#: The fields of structs that derive_search_columns reads.
SEARCHED = ("occurrence.periodo", "occurrence.hora_ocorrencia")


def summarize_records(records: Column) -> Column:
    """O-6.10: the number of records in all and of each kind."""
    count = lambda test: F.size(F.filter(records, test))
    own = [count(_is_type(t)).alias(n) for n, t in _SUMMARY]
    return F.struct(F.size(records).alias("total_records"), *own, count(lambda r: F.startswith(r["type"], F.lit("produtividade"))).alias("produtividade_count"))


def _is_type(name: str):
    return lambda r: r["type"] == name


def group_features(rows: DataFrame) -> DataFrame:
    """O-6.9: one feature for each key and source table.

    Place, time and category are the first row's, in the order of the reported location and
    id; every row gives its record and its rubric.
    """
    first = F.struct(F.col("lat_bucket"), F.col("lon_bucket"), F.col("id"))
    taken = [F.min_by(c, first).alias(c) for c in ("latitude", "longitude", "category", "rubrica_for_styling", "data_ocorrencia", "location", "occurrence")]
    grouped = rows.groupBy(*KEY, "source_table").agg(*taken, F.sort_array(F.collect_list(F.struct("id", "record"))).alias("kept"), F.array_sort(F.collect_set("record.rubrica")).alias("all_rubricas"))
    return grouped.withColumn("records", F.transform("kept", lambda x: x["record"])).drop("kept")


def _last_known(c: Column, order: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), order))


def merge_features(parts: DataFrame) -> DataFrame:
    """O-6.11: features of all tables, folded in the order of the tables' names.

    Last table: category and styling. Last known: date and each field of location and
    occurrence. First table: coordinates. Rubrics and tables are united, records follow each
    other. The rows' columns: those of group_features.
    """
    order = F.col("source_table")
    fields = lambda struct, names: F.struct(*[_last_known(F.col(f"{struct}.{f}"), order).alias(f) for f in names]).alias(struct)
    merged = parts.groupBy(*KEY).agg(
        F.min_by("latitude", order).alias("latitude"), F.min_by("longitude", order).alias("longitude"), F.max_by("category", order).alias("category"), F.max_by("rubrica_for_styling", order).alias("rubrica_for_styling"),
        _last_known(F.col("data_ocorrencia"), order).alias("data_ocorrencia"), F.array_sort(F.collect_set("source_table")).alias("source_tables"), fields("location", LOCATION), fields("occurrence", OCCURRENCE),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("all_rubricas")))).alias("all_rubricas"), F.sort_array(F.collect_list(F.struct("source_table", "records"))).alias("kept"))
    whole = merged.withColumn("records", F.flatten(F.transform("kept", lambda x: x["records"]))).drop("kept")
    return whole.withColumn("summary", summarize_records(F.col("records")))


def narrowed(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows (source_rows) with some fields of their structs alone, as ``record.marca``; a struct without any goes.

    Spark prunes no field of what is collected into arrays, so what is not read later would be
    made, moved and sorted all the same. A record keeps what features are made of.
    """
    wanted = {*fields, "record.type", "record.source_table", "record.rubrica"}
    kept = {s: [f for f in rows.schema[s].dataType.names if f"{s}.{f}" in wanted] for s in ("location", "occurrence", "record")}
    if unknown := wanted - {f"{s}.{f}" for s, names in kept.items() for f in names}:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return rows.withColumns({s: F.struct(*[F.col(f"{s}.{f}") for f in names]) for s, names in kept.items() if names}).drop(*[s for s, names in kept.items() if not names])


def features_of_rows(rows: DataFrame) -> DataFrame:
    """O-6.9 and O-6.11 at once: what merge_features makes of group_features.

    A key's rows are collected once, in the order of table, location and id. A key has few
    rows, and most have one table each, so two aggregations would sort and copy nearly every
    row again. The rules of both read the first row of each table.
    """
    kinds = {c: rows.schema[c].dataType for c in ("data_ocorrencia", "location", "occurrence") if c in rows.columns}
    order = ("source_table", "lat_bucket", "lon_bucket", "id")
    taken = ("latitude", "longitude", "category", "rubrica_for_styling", *kinds, "record")
    met = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*order, *taken))).alias("_rows"))
    met = met.withColumn("_firsts", F.filter("_rows", lambda r, k: (k == 0) | (F.get("_rows", k - 1)["source_table"] != r["source_table"])))
    structs = [c for c in kinds if c != "data_ocorrencia"]
    later = lambda known, r, struct: F.struct(*[F.coalesce(r[struct][f], known[struct][f]).alias(f) for f in kinds[struct].names]).alias(struct)
    known = F.aggregate("_firsts", F.struct(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]), lambda known, r: F.struct(
        F.coalesce(r["data_ocorrencia"], known["data_ocorrencia"]).alias("data_ocorrencia"), *[later(known, r, c) for c in structs]))
    first, last = F.get("_firsts", F.lit(0)), F.try_element_at("_firsts", F.lit(-1))
    records = F.sort_array(F.transform("_rows", lambda r: F.struct(r["source_table"], r["id"], r["record"].alias("record"))))
    whole = met.withColumn("_known", known).select(
        *KEY, first["latitude"].alias("latitude"), first["longitude"].alias("longitude"), last["category"].alias("category"), last["rubrica_for_styling"].alias("rubrica_for_styling"), "_known.data_ocorrencia",
        F.transform("_firsts", lambda r: r["source_table"]).alias("source_tables"), *[f"_known.{c}" for c in structs],
        F.array_sort(F.array_distinct(F.filter(F.transform("_rows", lambda r: r["record"]["rubrica"]), lambda x: x.isNotNull()))).alias("all_rubricas"), F.transform(records, lambda x: x["record"]).alias("records"))
    return whole.withColumn("summary", summarize_records(F.col("records")))


def build_features(tables: dict[str, DataFrame], fields: tuple[str, ...] | None = None) -> DataFrame:
    """Features of all raw tables by one shuffle on the key. fields: those of structs that are kept (narrowed), else all."""
    taken = lambda df, name: source_rows(df, name) if fields is None else narrowed(source_rows(df, name), fields)
    rows = reduce(DataFrame.unionByName, [taken(df, name) for name, df in sorted(tables.items())])
    return features_of_rows(rows.repartition(*KEY))


def remove_source_table(features: DataFrame, table: str) -> DataFrame:
    """O-6.12: without a table's records; features fed by it alone go. Place, date and category stay as they are."""
    rest = F.filter("records", lambda r: r["source_table"] != table)
    kept = features.where(~((F.size("source_tables") == 1) & F.array_contains("source_tables", table)))
    touched = F.array_contains("source_tables", table)
    rubrics = F.array_sort(F.array_distinct(F.filter(F.transform(rest, lambda r: r["rubrica"]), lambda x: x.isNotNull())))
    out = kept.withColumn("all_rubricas", F.when(touched, rubrics).otherwise(F.col("all_rubricas"))).withColumn("records", F.when(touched, rest).otherwise(F.col("records")))
    return out.withColumn("source_tables", F.array_remove("source_tables", table)).withColumn("summary", summarize_records(F.col("records")))


def refresh_features(features: DataFrame, rows: DataFrame, tables: list[str]) -> DataFrame:
    """O-6.13 for some tables at once: their rows (source_rows) instead of those they gave before.

    As if the tables came one after another by name: what a feature is without them is kept
    under the new rows by the rules of O-6.11, unless nothing else feeds it when the last of
    its old tables goes. Old and new features meet in one aggregation on the key, however
    many tables come.
    """
    names = F.array(*map(F.lit, sorted(set(tables))))
    rest = F.filter("records", lambda r: ~F.array_contains(names, r["source_table"]))
    touched = F.arrays_overlap("source_tables", names)
    rubrics = F.array_distinct(F.filter(F.transform(rest, lambda r: r["rubrica"]), lambda x: x.isNotNull()))
    old = features.withColumns({"all_rubricas": F.when(touched, rubrics).otherwise(F.col("all_rubricas")), "records": F.when(touched, rest).otherwise(F.col("records")),
                                "_was": F.array_max("source_tables"), "source_tables": F.array_except("source_tables", names)})
    new = features_of_rows(rows.repartition(*KEY)).withColumn("_was", F.lit(None).cast("string"))
    columns = [c for c in new.columns if c not in (*KEY, "summary")]
    side = lambda df, name, other: df.select(*KEY, F.struct(*columns).alias(name), F.lit(None).alias(other))
    both = side(old, "o", "n").unionByName(side(new, "n", "o"))
    met = both.groupBy(*KEY).agg(F.first("o", True).alias("o"), F.first("n", True).alias("n"))
    fed = (F.size("o.source_tables") > 0) | (F.col("n").isNotNull() & (F.get("n.source_tables", F.lit(0)) < F.col("o._was")))
    met = met.withColumn("o", F.when(fed, F.col("o"))).where("o is not null or n is not null")
    either = lambda first, then, c: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{then}.{c}")).alias(c)
    last_known = lambda struct, names: F.struct(*[F.coalesce(F.col(f"n.{struct}.{f}"), F.col(f"o.{struct}.{f}")).alias(f) for f in names]).alias(struct)
    all_of = lambda c: F.flatten(F.array_compact(F.array(F.col(f"o.{c}"), F.col(f"n.{c}"))))
    whole = met.select(*KEY, either("o", "n", "latitude"), either("o", "n", "longitude"), either("n", "o", "category"), either("n", "o", "rubrica_for_styling"), either("n", "o", "data_ocorrencia"),
                       F.array_sort(F.array_distinct(all_of("source_tables"))).alias("source_tables"), last_known("location", LOCATION), last_known("occurrence", OCCURRENCE),
                       F.array_sort(F.array_distinct(all_of("all_rubricas"))).alias("all_rubricas"), all_of("records").alias("records"))
    return whole.withColumn("summary", summarize_records(F.col("records")))


def upsert_features(features: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """O-6.13: a table's rows instead of those it gave before, merged with the rules of O-6.11, what is there as the earlier."""
    return refresh_features(features, rows, [table])


def incremental_refresh(features: DataFrame, tables: dict[str, DataFrame], flagged: list[str]) -> DataFrame:
    """O-6.14: the flagged tables that have a configuration, all in one pass."""
    known = sorted(t for t in set(flagged) & set(tables) if source_config(t) is not None)
    return refresh_features(features, reduce(DataFrame.unionByName, [source_rows(tables[t], t) for t in known]), known) if known else features


def derive_search_columns(features: DataFrame) -> DataFrame:
    """O-6.15: the columns that filters and tiles read."""
    rubrics = F.array_sort(F.array_distinct(F.filter(F.transform("all_rubricas", lambda r: X.source_text(r)), lambda r: r.isNotNull())))
    return features.withColumns({"all_rubricas": rubrics}).withColumns({
        "periodo_normalized": X.normalize_period("occurrence.periodo"), "hora_ocorrencia": V.occurrence_hour("occurrence.hora_ocorrencia"), "total_records": F.coalesce("summary.total_records", F.size("records")),
        "search_categories": F.array_append("all_rubricas", F.col("category")), "x_3857": geo.mercator_x("longitude"), "y_3857": geo.mercator_y("latitude")})


def build_tile_points(features: DataFrame) -> DataFrame:
    """O-6.16: the thin table that tiles read, with the year to partition by."""
    return features.select(*KEY, "category", "rubrica_for_styling", "search_categories", "data_ocorrencia", "periodo_normalized", "hora_ocorrencia", "total_records", "x_3857", "y_3857", F.year("data_ocorrencia").alias("year"))


def date_range(features: DataFrame, date: str = "data_ocorrencia") -> DataFrame:
    """O-6.17: (min_date, max_date, default_after): three months before the last date, not before the first."""
    known = features.where(F.col(date) >= F.lit("2013-01-01").cast("date")).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))
    return known.withColumn("default_after", F.greatest("min_date", F.add_months("max_date", -3)))


def etl_status(rows: DataFrame, tables: list[str]) -> DataFrame:
    """O-6.18: (source_table, status, rows_processed) by table, from the rows that were grouped (source_rows); a table that gave none is pending."""
    counted = rows.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.sparkSession.createDataFrame([(t,) for t in sorted(set(tables))], "source_table string")
    told = asked.join(counted, "source_table", "left")
    return told.select("source_table", F.when(F.col("n") > 0, "completed").otherwise("pending").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("rows_processed")).orderBy("source_table")


def hydrate_missing_records(features: DataFrame, rows: DataFrame) -> DataFrame:
    """O-6.19: records of source tables that a feature names but has none of, from their raw rows (source_rows)."""
    have = F.array_distinct(F.transform("records", lambda r: r["source_table"]))
    keyed = features.withColumns({"_lat": V.location_bucket("latitude"), "_lon": V.location_bucket("longitude")})
    missing = keyed.select(*KEY, "_lat", "_lon", F.explode(F.array_except("source_tables", have)).alias("_table"))
    raw = rows.select(F.col("num_bo").alias("_num"), F.col("ano_bo").alias("_ano"), F.col("delegacia").alias("_del"), "lat_bucket", "lon_bucket", F.col("source_table").alias("_from"), "id", "record")
    same = (F.col("num_bo") == F.col("_num")) & (F.col("ano_bo") == F.col("_ano")) & F.col("delegacia").eqNullSafe(F.col("_del")) & (F.col("_lat") == F.col("lat_bucket")) & (F.col("_lon") == F.col("lon_bucket")) & (F.col("_table") == F.col("_from"))
    found = missing.join(raw, same).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("_table", "id", "record"))).alias("_found"))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.transform("_found", lambda x: x["record"]).alias("_found"))
    on = reduce(Column.__and__, [features[k].eqNullSafe(found[f"_{k}"]) for k in KEY])
    whole = features.join(found, on, "left").withColumn("records", F.when(F.col("_found").isNull(), F.col("records")).otherwise(F.concat("records", "_found")))
    return whole.drop("_found", *[f"_{k}" for k in KEY]).withColumn("summary", summarize_records(F.col("records")))
