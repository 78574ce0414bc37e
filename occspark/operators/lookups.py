"""Report lookups and joins with coroner records (O-9.*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import normalize_lookup_key, source_text
from ..sources.scratch import stored
from . import stats
from .features import date_range
from .filters import FeatureFilter
from .records import KEY

# The columns that filters and counts read.
_COUNTED = ("category", "all_rubricas", "search_categories", "data_ocorrencia", "periodo_normalized", "hora_ocorrencia", "latitude", "longitude")

# Where the columns of O-9.6 come from.
_OF = {"hora_ocorrencia": "occurrence.hora_ocorrencia", "data_registro": "occurrence.data_registro", "logradouro": "location.logradouro", "numero_logradouro": "location.numero", "bairro": "location.bairro", "cidade": "location.cidade",
       "local_tipo": "location.tipo_local", "periodo": "occurrence.periodo", "conduta": "occurrence.conduta", "natureza_apurada": "occurrence.natureza_apurada"}
#: What grouped_occurrences reads of structs.
GROUPED = (*_OF.values(), "occurrence.delegacia", "record.source_id")


def entry_time(c: Column) -> Column:
    """A coroner's entry date and time: day first with time, day first, or ISO."""
    t = F.trim(c)
    forms = (("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "d/M/y H:mm:ss"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/y"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"))
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in forms])


def coroner_join(features: DataFrame, coroner: DataFrame) -> DataFrame:
    """O-9.1: features with ``coroner``: their coroner records by entry time (unknown last), table and id.

    coroner has the columns of its tables, id and source_table. Keys are normalized once on
    each side; a feature without a unit has no records. The records are grouped before the
    join, so the features' rows are neither multiplied nor grouped again.
    """
    text = [c for c in coroner.columns if not c.startswith("_")]
    own = coroner.select(normalize_lookup_key("NUM_BO").alias("_num"), source_text("ANO_BO").alias("_ano"), normalize_lookup_key("DELEGACIA_REGISTRO").alias("_del"),
                         F.struct(F.coalesce(entry_time(F.col("DATA_ENTRADA_IML")), F.lit("9999-12-31").cast("timestamp")).alias("_at"), "source_table", "id", F.struct(*text).alias("_row")).alias("_x")).where("_del <> ''")
    grouped = own.groupBy("_num", "_ano", "_del").agg(F.sort_array(F.collect_list("_x")).alias("_rows"))
    same = (normalize_lookup_key("num_bo") == F.col("_num")) & (F.col("ano_bo").cast("string") == F.col("_ano")) & (normalize_lookup_key("delegacia") == F.col("_del"))
    joined = features.join(grouped, same, "left").withColumn("coroner", F.transform("_rows", lambda x: x["_row"]))
    return joined.drop("_num", "_ano", "_del", "_rows")


def features_by_report(features: DataFrame, num_bo: str, ano_bo: int | None = None, delegacia: str | None = None) -> DataFrame:
    """O-9.3: the features of a report, latest first, unknown dates before all. The unit is compared as it is; '' is that of features without one."""
    rows = features.where(F.col("num_bo") == num_bo.strip())
    rows = rows if ano_bo is None else rows.where(F.col("ano_bo") == ano_bo)
    rows = rows if delegacia is None else rows.where(F.coalesce("delegacia", F.lit("")) == delegacia)
    return rows.orderBy(F.desc_nulls_first("data_ocorrencia"), *KEY)


def features_by_reports(features: DataFrame, reports: DataFrame) -> DataFrame:
    """O-9.3 for a table of keys (num_bo, and ano_bo where it isn't NULL)."""
    keys = reports.select(F.col("num_bo").alias("_num"), F.col("ano_bo").alias("_ano"))
    return features.join(keys, (F.col("num_bo") == F.col("_num")) & (F.col("_ano").isNull() | (F.col("ano_bo") == F.col("_ano"))), "left_semi")


def summaries_by_report(features: DataFrame, num_bo: str, ano_bo: int | None = None, delegacia: str | None = None) -> DataFrame:
    """O-9.4: thin rows of O-9.3; a blank unit doesn't filter here."""
    rows = features_by_report(features, num_bo, ano_bo, delegacia or None)
    return rows.select(*KEY, "latitude", "longitude", "category", "rubrica_for_styling", "data_ocorrencia", "source_tables")


def feature_detail(features: DataFrame, coroner: DataFrame, num_bo: str, ano_bo: int | None = None, delegacia: str | None = None) -> DataFrame:
    """O-9.5: the first feature of a report with its coroner records."""
    return coroner_join(features_by_report(features, num_bo, ano_bo, delegacia).limit(1), coroner)


def grouped_occurrences(features: DataFrame) -> DataFrame:
    """O-9.6: a row for each record, by id ``table:source_id``; a feature without records gives one of its own.

    The columns from primary_category on are those of the report that the row belongs to.
    """
    first_table = F.coalesce(F.get("source_tables", F.lit(0)), F.lit("unknown"))
    rows = features.select(*KEY, "latitude", "longitude", "category", "rubrica_for_styling", "data_ocorrencia", "source_tables", *[F.col(c).alias(n) for n, c in _OF.items()], F.coalesce("occurrence.delegacia", "delegacia").alias("unit"), "all_rubricas",
                           F.greatest(F.coalesce("total_records", F.lit(0)), F.lit(1)).alias("record_count"), F.explode_outer("records").alias("r"))
    known = F.col("r").isNotNull()
    alone = F.concat_ws(":", F.lit("map_features"), F.col("num_bo"), F.col("ano_bo").cast("string"), F.col("location_hash"))
    return rows.select(F.when(known, F.concat_ws(":", "r.source_table", F.col("r.source_id").cast("string"))).otherwise(alone).alias("occurrence_id"), F.when(known, F.col("r.source_table")).otherwise(first_table).alias("source_table"), "num_bo", "ano_bo", "location_hash",
                       F.coalesce(F.nullif("r.rubrica", F.lit("")), "category").alias("category"), "rubrica_for_styling", "latitude", "longitude", "data_ocorrencia", *_OF, F.col("unit").alias("delegacia"), V.record_type_label("r.type").alias("record_label"),
                       F.col("category").alias("primary_category"), F.when(F.size("all_rubricas") > 0, F.col("all_rubricas")).otherwise(F.array("category")).alias("all_categories"), "source_tables", "record_count")


def tile_metadata(features: DataFrame, where: FeatureFilter | None = None) -> DataFrame:
    """O-9.7: one row: date range, number of features, categories and periods, each small."""
    where = where or FeatureFilter()
    features = stored(features.select(*[c for c in features.columns if c in _COUNTED]), "metadata")  # three aggregations read them
    both = stats.category_period_stats(features, where)
    listed = both.groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "count")))).alias(f"{k}_counts") for k in ("category", "period")])
    return date_range(features).join(stats.count_features(features, where)).join(listed)
