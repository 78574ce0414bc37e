"""Statistics and charts of filtered features (O-8.*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import source_text
from .filters import FeatureFilter, radius_filter

#: Rows of a chart.
CHART_ROWS = 12
CHARTS = ("category", "period", "weekday", "location_type", "police_circumscription", "police_unit", "record_type", "object_type", "vehicle_brand", "phone_brand", "weapon_type", "drug_type")
NO_BRAND = "Marca não informada"


def buckets() -> Column:
    """O-8.1: the distinct, trimmed rubrics and the category of a feature."""
    return F.array_distinct(F.filter(F.transform(F.array_append("all_rubricas", F.col("category")), lambda x: source_text(x)), lambda x: x.isNotNull()))


def category_buckets(features: DataFrame) -> DataFrame:
    """O-8.1: a row for each feature and bucket, with the feature's columns."""
    return features.withColumn("bucket", F.explode(buckets()))


def category_stats(features: DataFrame) -> DataFrame:
    """O-8.2: (category, count, rubrica_for_styling, kind), most first, then by name."""
    rows = category_buckets(features.select("all_rubricas", "category", "rubrica_for_styling"))
    own = F.when(F.trim("category") == F.col("bucket"), F.col("rubrica_for_styling"))
    out = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.max(own).alias("styling"), F.bool_or(F.array_contains("all_rubricas", F.col("bucket"))).alias("is_rubric"))
    told = out.select(F.col("bucket").alias("category"), "count", F.coalesce("styling", "bucket").alias("rubrica_for_styling"), F.when(F.col("is_rubric"), "rubrica").otherwise("derived").alias("kind"))
    return told.orderBy(F.desc("count"), "category")


def category_stats_for_location(features: DataFrame, lon: float, lat: float, metres: float, where: FeatureFilter | None = None) -> DataFrame:
    """O-8.3: O-8.2 within a radius."""
    near = features.where(radius_filter(lon, lat, metres))
    return category_stats(near.where(where.column()) if where else near)


def period_stats(features: DataFrame, where: FeatureFilter | None = None) -> DataFrame:
    """O-8.4: (period, label, count) of known periods, in order of the day; the filter's own periods don't count."""
    rows = features.where((where or FeatureFilter()).without(periods=()).column()).where("periodo_normalized is not null")
    out = rows.groupBy(F.col("periodo_normalized").alias("period")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("period", V.period_label("period").alias("label"), "count").orderBy(V.period_sort("period"), "label")


def category_period_stats(features: DataFrame, where: FeatureFilter) -> DataFrame:
    """O-8.5: (kind, name, count): categories under the whole filter, periods under all but its periods. One scan, one shuffle."""
    rows = features.where(where.without(periods=()).column())
    inside = F.coalesce(FeatureFilter(periods=where.periods).column(), F.lit(False))
    category = F.when(inside, F.transform(buckets(), lambda b: F.struct(F.lit("category").alias("kind"), b.alias("name"))))
    period = F.when(F.col("periodo_normalized").isNotNull(), F.array(F.struct(F.lit("period").alias("kind"), F.col("periodo_normalized").alias("name"))))
    none = F.array().cast("array<struct<kind:string,name:string>>")
    each = rows.select(F.explode(F.concat(F.coalesce(category, none), F.coalesce(period, none))).alias("x"))
    return each.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("count"))


def count_features(features: DataFrame, where: FeatureFilter | None = None) -> DataFrame:
    """O-8.6: one row with the number."""
    return features.where((where or FeatureFilter()).column()).agg(F.count(F.lit(1)).alias("count"))


def totals(features: DataFrame) -> DataFrame:
    """O-8.7: features and their records."""
    return features.agg(F.count(F.lit(1)).alias("total_features"), F.coalesce(F.sum("total_records"), F.lit(0)).cast("long").alias("total_records"))


def _entry(chart: str, label: Column, amount: Column | None = None, sort: Column | None = None) -> Column:
    named = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(V.NOT_INFORMED))
    return F.struct(F.lit(chart).alias("chart"), named.alias("label"), (amount if amount is not None else F.lit(None)).cast("double").alias("amount"), (sort if sort is not None else F.lit(None)).cast("int").alias("sort"))


def _feature_entries(names: tuple[str, ...]) -> list[Column]:
    """O-8.9, O-8.10, O-8.15, O-8.16, O-8.17, as far as they are named."""
    told = {"period": (V.period_label("periodo_normalized"), V.period_sort("periodo_normalized")), "weekday": (V.weekday_label("data_ocorrencia"), V.weekday_sort("data_ocorrencia")),
            "location_type": (F.col("location.tipo_local"), None), "police_circumscription": (F.col("occurrence.delegacia_circunscricao"), None), "police_unit": (F.col("delegacia"), None)}
    return [_entry(chart, label, sort=sort) for chart, (label, sort) in told.items() if chart in names]


def _record_entries(r: Column, names: tuple[str, ...]) -> Column:
    """O-8.11 to O-8.14, O-8.18, O-8.19 of one record, as far as they are named."""
    text = lambda name: F.nullif(r[name].cast("string"), F.lit(""))
    brand = F.coalesce(text("marca"), F.lit(NO_BRAND))
    quantity = V.record_quantity(r["quantidade"])
    told = {"record_type": (F.lit(True), V.record_type_label(r["type"]), None),
            "object_type": (r["type"].isin("objeto", "celular"), F.coalesce(text("descr_tipo_objeto"), text("descr_subtipo_objeto")), quantity),
            "vehicle_brand": (r["type"].isin("veiculo", "produtividade_veiculos"), F.concat_ws(" · ", brand, text("tipo_veiculo"), text("ano_modelo")), None),
            "phone_brand": (r["type"] == "celular", F.concat_ws(" · ", brand, text("descr_subtipo_objeto")), quantity),
            "weapon_type": (r["type"] == "produtividade_armas", F.coalesce(text("tipo_arma"), text("calibre")), None),
            "drug_type": (r["type"] == "produtividade_entorpecentes", text("tipo_droga"), V.drug_grams(r["quantidade_gramas"]))}
    return F.array_compact(F.array(*[F.when(test, _entry(chart, label, amount)) for chart, (test, label, amount) in told.items() if chart in names]))


def all_charts(features: DataFrame, rows: int = CHART_ROWS, names: tuple[str, ...] = CHARTS) -> DataFrame:
    """O-8.20: (chart, rank, label, count, amount) of the twelve charts, or of some of them.

    One scan: a feature gives its entries and its records' as one array, one aggregation by
    (chart, label) with partial sums follows, and only its result is ranked. Period and
    weekday go by their own order, others by count, then label.
    """
    if not names or not {*names} <= {*CHARTS}:
        raise ValueError(f"no such charts: {names}")
    own = _feature_entries(names)
    parts = [F.array(*own)] if own else []
    if "category" in names:
        parts.append(F.transform(buckets(), lambda b: _entry("category", b)))
    if {*names} & {*CHARTS[CHARTS.index("record_type"):]}:
        parts.append(F.flatten(F.transform("records", lambda r: _record_entries(r, names))))
    each = features.select(F.explode(F.concat(*parts)).alias("x"))
    counted = each.groupBy("x.chart", "x.label", "x.sort").agg(F.count(F.lit(1)).alias("count"), F.sum("x.amount").alias("amount"))
    order = Window.partitionBy("chart").orderBy(F.coalesce("sort", F.lit(0)), F.when(F.col("sort").isNull(), -F.col("count")).otherwise(0), "label")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("chart", "rank", "label", "count", "amount")


def chart(features: DataFrame, name: str) -> DataFrame:
    """O-8.8 to O-8.19: one of the twelve charts by its name; no other is made."""
    return all_charts(features, names=(name,)).drop("chart").orderBy("rank")


def merge_arrays(a: Column, b: Column) -> Column:
    """O-8.21: the distinct union of two arrays."""
    return F.array_union(a, b)
