"""Features by category: a table with a folder for each category, for filters on a feature's many categories (O-7.2, O-8.2, O-10.2).

A filter on an array column can't be pruned: any file may hold a wanted category. Here a
feature has a row in the folder of each of its categories, so a filter reads the folders that
it names. A feature of several wanted categories counts once, in that of least name, which is
also the category it is shown by; no rows have to meet for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions as VS
from .filters import clean_list
from .records import KEY

_FOLDER = "in_category"
#: What filters, statistics and tiles read of a feature.
COLUMNS = (*KEY, "category", "rubrica_for_styling", "all_rubricas", "search_categories", "data_ocorrencia", "periodo_normalized", "hora_ocorrencia", "total_records", "latitude", "longitude", "x_3857", "y_3857")


def write_category_index(features: DataFrame, path: str) -> int:
    """The index of features (derive_search_columns) instead of what was there; gives its number of rows.

    Folders are rebalanced: a category with very many features is written by several tasks.
    """
    each = features.select(*COLUMNS, F.explode(F.array_distinct("search_categories")).alias(_FOLDER)).where(F.col(_FOLDER).isNotNull())
    return VS.replace_all(each.hint("rebalance", _FOLDER).sortWithinPartitions(_FOLDER, "data_ocorrencia"), path, [_FOLDER])


def indexed_features(spark: SparkSession, path: str, categories: tuple[str, ...]) -> DataFrame:
    """O-7.2 from an index: the thin features that have any of the categories, each once, with the ``matched_category`` of O-10.2."""
    wanted = clean_list(categories)
    table = VS.listed(spark, path)
    rows = VS.read_parts(spark, path, table, [p for p in table.parts.values() if p.values()[_FOLDER] in wanted])
    least = F.array_min(F.array_intersect("search_categories", F.array(*map(F.lit, wanted)).cast("array<string>")))
    return rows.where(F.col(_FOLDER) == least).withColumnRenamed(_FOLDER, "matched_category")


def indexed_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Features of each category, from the index's list alone: nothing is read."""
    return {p.values()[_FOLDER]: p.rows for p in VS.listed(spark, path).parts.values()}
