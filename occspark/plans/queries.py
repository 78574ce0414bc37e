"""Queries over the test tables, one for each operator or small group of operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions import values as V
from ..operators import category_index as CI
from ..operators import feature_store as FS
from ..operators import features as FE
from ..operators import filters as FI
from ..operators import imports as IM
from ..operators import lookups as LO
from ..operators import records as R
from ..operators import stats as ST
from ..operators import tile_store as TS
from ..operators import tiles as TI
from ..sources import io, profile, schema, scratch
from . import fixtures as FX

#: The worked filter of the queries.
WHERE = FI.FeatureFilter(after="2024-01-05", before="2024-01-20", categories=("Furto - click", "Furto - view", "Outros"), periods=("  À   TARDE  ", "pela manhã"), hour_start=22, hour_end=14)

def _noisy(columns: Callable[[], list[Column]]):
    """A query of some expressions over the noisy cells; columns need a session, so they are made when it runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return FX.noisy(spark, sf_dir).select("id", *columns())

    return run

def _flag(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").alias(name)

def _text_date(c: Column) -> Column:
    return V.iso(c)

def flat(features: DataFrame) -> DataFrame:
    """Features as rows of plain values."""
    join = lambda c: F.array_join(c, "|")
    return features.select("num_bo", "ano_bo", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "location_hash", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "category", "rubrica_for_styling",
                           _text_date(F.col("data_ocorrencia")).alias("data_ocorrencia"), join("source_tables").alias("source_tables"), join("all_rubricas").alias("all_rubricas"), F.col("summary.total_records").alias("total_records"), F.col("summary.celulares_count").alias("celulares_count"), F.col("summary.produtividade_count").alias("produtividade_count"),
                           join(F.transform("records", lambda r: F.concat_ws(":", r["source_table"], r["source_id"].cast("string")))).alias("records"), F.col("location.tipo_local").alias("tipo_local"), F.col("occurrence.periodo").alias("periodo"))

#: What flat reads of structs.
FLAT = ("record.source_id", "location.tipo_local", "occurrence.periodo")

def _flat_query(tables: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = FX.raw_tables(spark, sf_dir)
        return flat(FE.build_features({t: raw[t] for t in tables}))

    return run

def group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.9 of each table by itself."""
    raw = FX.raw_tables(spark, sf_dir)
    rows = reduce(DataFrame.unionByName, [R.source_rows(df, t) for t, df in raw.items()])
    got = FE.group_features(rows)
    return got.select("num_bo", "ano_bo", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "location_hash", "source_table", "category", _text_date(F.col("data_ocorrencia")).alias("data_ocorrencia"), F.size("records").cast("long").alias("n_records"), F.array_join("all_rubricas", "|").alias("all_rubricas"))

def remove_source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.12."""
    raw = FX.raw_tables(spark, sf_dir)
    return flat(FE.remove_source_table(FE.build_features(raw, FLAT), "objetos_2024"))

def upsert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.13, O-6.14: tables that come one after another, in the order of their names."""
    raw = FX.raw_tables(spark, sf_dir)
    first, *rest = sorted(FX.TABLES)
    features = FE.build_features({first: raw[first]})
    return flat(FE.incremental_refresh(features, raw, rest))

def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.15, O-6.16."""
    f = FX.search_features(spark, sf_dir)
    return f.select("num_bo", "location_hash", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "periodo_normalized", "hora_ocorrencia", "total_records", F.array_join("search_categories", "|").alias("search_categories"), F.round("x_3857", 2).alias("x"), F.round("y_3857", 2).alias("y"))

def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.19: features whose records of one table were lost get them back."""
    raw = FX.raw_tables(spark, sf_dir)
    features = FE.build_features(raw, ())
    lost = features.withColumn("records", F.filter("records", lambda r: r["source_table"] != "veiculos_2024"))
    got = FE.hydrate_missing_records(lost, FE.narrowed(R.source_rows(raw["veiculos_2024"], "veiculos_2024"), ()))
    return got.select("num_bo", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "location_hash", F.col("summary.total_records").alias("total_records"), F.col("summary.veiculos_count").alias("veiculos_count"))

def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.17 over orders, moved to the years that count."""
    orders = FX.load(spark, sf_dir, "orders").select(F.add_months(F.to_date("o_orderdate"), 240).alias("data_ocorrencia"))
    return FE.date_range(orders).select(*[_text_date(F.col(c)).alias(c) for c in ("min_date", "max_date", "default_after")])

def etl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.18."""
    raw = FX.raw_tables(spark, sf_dir)
    rows = reduce(DataFrame.unionByName, [R.source_rows(df, t) for t, df in raw.items()])
    return FE.etl_status(rows, [*raw, "dados_criminais_2013"])

def _count(name: str, condition) -> DataFrame:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = FX.search_features(spark, sf_dir, fields=())
        return f.where(condition()).groupBy("category").agg(F.count(F.lit(1)).alias("count"))

    run.__doc__ = name
    return run

def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.1, O-8.2 under the filter."""
    return ST.category_stats(FX.search_features(spark, sf_dir).where(WHERE.without(categories=()).column()))

def category_stats_for_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.3."""
    return ST.category_stats_for_location(FX.search_features(spark, sf_dir), -46.15, -23.12, 10_000)

def period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.4."""
    return ST.period_stats(FX.search_features(spark, sf_dir), WHERE)

def category_period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.5."""
    return ST.category_period_stats(FX.search_features(spark, sf_dir, fields=()), WHERE)

def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.6, O-8.7."""
    return ST.totals(FX.search_features(spark, sf_dir).where(WHERE.column()))

def all_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.8 to O-8.20."""
    return ST.all_charts(FX.search_features(spark, sf_dir)).withColumn("amount", F.round("amount", 2))

def coroner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.1: per feature its coroner records' ids in order."""
    f = LO.coroner_join(FX.search_features(spark, sf_dir), FX.coroner(spark, sf_dir))
    return f.select("num_bo", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "location_hash", F.coalesce(F.array_join(F.transform("coroner", lambda c: c["id"].cast("string")), ","), F.lit("")).alias("coroner_ids"))

def by_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.3, O-9.4: the reports that a table of keys names."""
    f = FX.search_features(spark, sf_dir)
    keys = FX.load(spark, sf_dir, "customer").select(F.concat(F.lit("DU"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("num_bo"), F.when(F.col("c_custkey") % 2 == 0, 2024).alias("ano_bo"))
    return LO.features_by_reports(f, keys).select("num_bo", "ano_bo", "location_hash", "category", _text_date(F.col("data_ocorrencia")).alias("data_ocorrencia"), "total_records")

def grouped_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.6."""
    g = LO.grouped_occurrences(FX.search_features(spark, sf_dir, fields=LO.GROUPED))
    plain = [c for c in g.columns if c not in ("data_ocorrencia", "latitude", "longitude", "all_categories", "source_tables", "delegacia")]
    return g.select(*plain, F.coalesce("delegacia", F.lit("")).alias("delegacia"), _text_date(F.col("data_ocorrencia")).alias("data_ocorrencia"), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.array_join("all_categories", "|").alias("all_categories"), F.array_join("source_tables", "|").alias("source_tables"))

def cluster_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10.3, O-10.4."""
    c = TI.cluster_pyramid(FE.build_tile_points(FX.search_features(spark, sf_dir)))
    return c.select("zoom", "tile_x", "tile_y", "cell_x", "cell_y", "category", "cluster_count", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.col("is_singleton").cast("int").alias("is_singleton"), "num_bo")

def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10.1, O-10.2, O-10.5, O-10.6."""
    p = TI.raw_points(FE.build_tile_points(FX.search_features(spark, sf_dir)), 16, ("Furto - click", "Furto - view"))
    return p.select("num_bo", "location_hash", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "category", "tile_x", "tile_y", "pixel_x", "pixel_y")

def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-5.1 to O-5.4 over four of customer's columns."""
    customer = FX.load(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")])
    got = profile.infer_type(profile.profile_columns(customer))
    return got.select("column", "null_count", "total_count", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), "numeric_min", "numeric_max", F.col("all_integer").cast("int").alias("all_integer"), "inferred_type")

def prepare_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-2.3, O-5.5, O-5.6: two equal columns, one to be cleaned as time, one as a number."""
    n = FX.noisy(spark, sf_dir).select(F.col("id").cast("string").alias("ID"), F.col("v").alias("HORA FATO"), F.col("v").alias("hora fato"), F.col("v").alias("QTDE (GRAMAS)"))
    out, _ = profile.prepare_table(n, {"ID": "INT", "HORA_FATO": "TIME", "QTDE_GRAMAS": "NUMERIC"})
    return out

def write_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.3, O-1.4, O-1.15, O-1.17: the text form of noisy cells without empty rows."""
    n = FX.noisy(spark, sf_dir).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("a"), F.col("v").alias("b"))
    return io.text_columns(io.drop_empty_rows(n)).select("a", io.escape_formula(F.col("b")).alias("b"))

def evolve_and_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.8, O-1.9, O-8.22: rows by table and which of two drifting columns they have."""
    raw = FX.raw_tables(spark, sf_dir)
    tables = {"celulares_2023": raw["celulares_2024"].select("id", "NUM_BO", "CIDADE"), "celulares_2024": raw["objetos_2024"].select("id", "NUM_BO", F.col("CIDADE").alias("NOME_MUNICIPIO")), "veiculos_2024": raw["veiculos_2024"].select("id", "NUM_BO")}
    u = io.union_source_tables(tables, "celulares")
    return u.groupBy("source_table").agg(F.count(F.lit(1)).alias("rows"), F.count("CIDADE").alias("with_city"), F.count("NOME_MUNICIPIO").alias("with_town"))

def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    orders = FX.load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 14).alias("k"), (F.year("o_orderdate") + 25).alias("year"))
    category = F.concat(F.lit("cat"), F.col("k").cast("string")).alias("category")
    catalog = orders.select(category, "year").distinct()
    counts = orders.where("k % 5 <> 1").groupBy(category, "year").agg(F.when(F.first("k") % 7 == 3, 0).otherwise(F.count(F.lit(1))).alias("rows"))
    stored = catalog.where("year % 2 = 0").select("category", "year", F.lit("a").alias("file_hash"))
    fresh = catalog.where("length(category) = 4").select("category", "year", F.when(F.col("year") % 4 == 0, "a").otherwise("b").alias("file_hash"))
    return catalog, counts, stored, fresh

def import_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.1, O-11.4."""
    catalog, counts, stored, fresh = _catalog(spark, sf_dir)
    return IM.import_decisions(IM.import_status(catalog, counts), stored, fresh, "2026-03-15").select("category", "year", F.col("import").cast("int").alias("import"), "reason")

def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.3."""
    catalog, counts, _, _ = _catalog(spark, sf_dir)
    return IM.tables_needing_attention(IM.import_status(catalog, counts))

def import_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.2."""
    catalog, counts, _, _ = _catalog(spark, sf_dir)
    return IM.import_statistics(IM.import_status(catalog, counts))

def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.5."""
    _, _, stored, fresh = _catalog(spark, sf_dir)
    return IM.changed_files(stored, fresh, ["category", "year"])

def month_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.6, O-11.7: months of events and orders are there; the rest, and the last three, are to be fetched."""
    events = FX.load(spark, sf_dir, "events").select(F.year("ts").cast("string").alias("ANO_REFERENCIA"), F.lpad(F.month("ts").cast("string"), 2, "0").alias("MES_REFERENCIA")).distinct()
    orders = FX.load(spark, sf_dir, "orders").select((F.year("o_orderdate") + 20).cast("string").alias("ANO_REFERENCIA"), F.month("o_orderdate").cast("string").alias("MES_REFERENCIA")).distinct()
    have = IM.imported_months(events.union(orders))
    calendar = events.agg(F.lit("2024-02-10").cast("date").alias("now"))
    return IM.coroner_month_targets(calendar, have, have.where("month <> 5"))

def csv_round_trip(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """O-1.1, O-1.2: noisy cells with separators, quotes and line breaks, written and read again under a header that needs quotes."""
    n = FX.noisy(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.concat("v", F.when(F.col("id") % 3 == 0, F.lit(';"x"\ny')).otherwise("")).alias("a;b"))
    path = scratch.new_path(spark, "csv")
    io.write_source_csv(n, path)
    return io.read_source_csv(spark, path, split=split).select(F.col("id"), F.coalesce(F.col("`a;b`"), F.lit("")).alias("v"))

def csv_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.1: the same files, each read by the tasks of its splits."""
    return csv_round_trip(spark, sf_dir, split=True)

def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.3, O-1.4: a table's text form, written and read again."""
    path = scratch.new_path(spark, "text")
    io.write_parquet_text(FX.noisy(spark, sf_dir), path)
    return io.read_parquet_text(spark, path)

def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.5: orders and what was fulfilled of them, one after another."""
    orders = FX.load(spark, sf_dir, "orders")
    both = io.merge_tables([orders, orders.where("o_orderstatus = 'F'")])
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))

def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.6: the first five of the ordered customers."""
    return io.sample_rows(FX.load(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name"))

def select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.7, O-1.16: file and sheet names made from customers."""
    kind = F.element_at(F.array(*map(F.lit, ("Dados Crimináis", "METODOLOGIA", "dicionário de dados", "Veículos Recuperados", "Tabela de Campos"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    files = FX.load(spark, sf_dir, "customer").select(F.concat_ws("_", kind, "c_mktsegment", F.col("c_custkey").cast("string")).alias("name"))
    return io.select_files_for_category(files, ["veículos recuperados", "Building", "dicionario"]).select("name", _flag(io.is_data_sheet(F.col("name")), "is_data"))

def evolve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.9: rows that name a column another way and bring a new one."""
    customer = FX.load(spark, sf_dir, "customer")
    incoming = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("C CUSTKEY"), F.col("c_mktsegment").alias("segment"))
    return io.evolve_table(customer.select("c_custkey", "c_name"), incoming)

def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.10: orders replace what was there; ids follow date and key."""
    path = scratch.new_path(spark, "orders")
    orders = FX.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    io.replace_table([orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")], path)
    return io.with_stable_ids(io.read_table(spark, path), ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")

def replace_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.11: orders by month; then the months from July on anew, with fewer rows."""
    path = scratch.new_path(spark, "months")
    orders = FX.load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("ANO_REFERENCIA"), F.date_format("o_orderdate", "MM").alias("MES_REFERENCIA"))
    io.replace_month(orders, path)
    io.replace_month(orders.where("MES_REFERENCIA >= '07' and o_orderkey % 2 = 0"), path)
    months = io.read_table(spark, path)
    return months.groupBy(F.col("ANO_REFERENCIA").alias("year"), F.col("MES_REFERENCIA").alias("month")).agg(F.count(F.lit(1)).alias("rows"))

def coroner_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.12: an export in UTF-16 with tabs, written and read again."""
    e = FX.load(spark, sf_dir, "events")
    at = F.concat(F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit("/01/2024"))
    cells = {"DataEntradaIML": F.when(F.col("event_id") % 4 == 0, " ").otherwise(at), "AnoBO": F.lit("2024"), "NumeroBO": F.concat(F.lit(" du-"), F.col("event_id").cast("string")), "NomeDelegaciaOrigem": F.concat(F.lit("01º D.P. Mauá "), (F.col("event_id") % 3).cast("string")), "CausaMortis": F.concat(F.lit("causa "), (F.col("event_id") % 5).cast("string"))}
    blank = F.col("event_id") % 10 == 0
    path = scratch.new_path(spark, "coroner")
    e.select(*[F.when(blank, " ").otherwise(cells.get(c, F.lit(" "))).alias(c) for c in io.CORONER_INPUT]).write.csv(path, sep="\t", header=True, encoding="UTF-16LE", emptyValue="")
    return io.read_coroner_export(spark, path, 2024, 1).select("NUM_BO", "DATA_ENTRADA_IML", "CAUSA_MORTIS", "ANO_REFERENCIA", "MES_REFERENCIA", "NUM_BO_NORMALIZED", "DELEGACIA_REGISTRO_NORMALIZED")

def hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1.13: one file of order keys for each priority."""
    path = scratch.new_path(spark, "files")
    orders = FX.load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    orders.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey").select(F.col("o_orderkey").cast("string"), "o_orderpriority").write.partitionBy("o_orderpriority").text(path)
    return io.hash_files(spark, f"{path}/*/*.txt").select("sha256", "size")

def _renamed(names: tuple[str, ...], fix) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = FX.noisy(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "v", F.upper("v").alias("u"), F.concat(F.lit("x"), "v").alias("x")).toDF(*names)
        return fix(n)

    return run

def _typed(df: DataFrame) -> DataFrame:
    """O-2.6: cleaned by types of which two are overridden by other spellings of the names."""
    types = schema.apply_type_overrides({"ID": "INT", "QTDE (GRAMAS)": "TEXT", "HORA FATO": "TEXT", "X": "TEXT"}, {"QTDE_GRAMAS": "NUMERIC", "hora fato": "TIME", "gone": "DATE"})
    return profile.prepare_table(df, types)[0]

def profile_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-5.2: distinct values, few or past the cap."""
    customer = FX.load(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")])
    return profile.profile_columns(customer).select("column", F.col("unique_count").cast("long").alias("unique_count"))

def profile_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-5.3: what reads as a number: exponents, bare points and infinities do, type suffixes and digit groups don't."""
    k = F.col("event_id")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (k % len(values) + 1).cast("int"))
    e = FX.load(spark, sf_dir, "events").select(pick(F.concat((k % 90).cast("string"), F.lit("e1")), "+.5", "-7.", "inf", " NaN ", "").alias("floats"), pick("1e3", "2.0", "NULL").alias("whole"), pick("1", "1d").alias("suffixed"), pick("1_000", "3").alias("grouped"))
    return profile.profile_columns(e).select("column", "null_count", "total_count", "numeric_min", "numeric_max", F.col("all_numeric").cast("int").alias("all_numeric"), F.col("all_integer").cast("int").alias("all_integer"))

def other_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.5, O-6.6 e, g, h: the other record types and the occurrence's flag and dates, row by row."""
    rows = reduce(DataFrame.unionByName, [R.source_rows(df, t) for t, df in FX.other_tables(spark, sf_dir).items()])
    return rows.select("id", "source_table", "category", "rubrica_for_styling", F.col("record.type").alias("type"), *[F.col(f"record.{c}").alias(c) for c in ("tipo_arma", "calibre", "marca", "placa", "tipo_veiculo", "ano_modelo", "idade", "cor", "natureza_apurada")],
                       F.col("occurrence.flagrante").cast("int").alias("flagrante"), F.col("occurrence.data_registro").alias("data_registro"))

def weapon_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.18."""
    return ST.chart(FE.derive_search_columns(FE.build_features(FX.other_tables(spark, sf_dir), (*FE.SEARCHED, "record.tipo_arma", "record.calibre"))), "weapon_type").select("rank", "label", "count")

def upsert_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.14: of features of all tables, three tables come anew, each with the rows of every other report alone."""
    raw = FX.raw_tables(spark, sf_dir)
    fresh = {t: raw[t].where("cast(substring(NUM_BO, 3, 6) AS int) % 2 = 0") for t in ("celulares_2024", "dados_criminais_2024", "veiculos_2024")}
    return flat(FE.incremental_refresh(FE.build_features(raw), fresh, [*fresh, "unknown_2024"]))

def _store(spark: SparkSession, features: DataFrame) -> str:
    path = scratch.new_path(spark, "features")
    FS.write_features(features, path)
    return path

def stored_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.14 on a store of all features: three tables come anew, each with the rows of every other report alone."""
    raw = FX.raw_tables(spark, sf_dir)
    path = _store(spark, FE.build_features(raw))
    fresh = {t: raw[t].where("cast(substring(NUM_BO, 3, 6) AS int) % 2 = 0") for t in ("celulares_2024", "dados_criminais_2024", "veiculos_2024")}
    FS.refresh_store(spark, path, fresh, [*fresh, "unknown_2024"])
    return flat(FS.read_features(spark, path))

def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.3 from a store: the reports that a table of keys names."""
    path = _store(spark, FX.search_features(spark, sf_dir))
    keys = FX.load(spark, sf_dir, "customer").select(F.concat(F.lit("DU"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("num_bo"), F.when(F.col("c_custkey") % 2 == 0, 2024).alias("ano_bo"))
    return FS.stored_features_by_reports(spark, path, keys).select("num_bo", "ano_bo", "location_hash", "category", _text_date(F.col("data_ocorrencia")).alias("data_ocorrencia"), "total_records")

def stored_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.5 from stores of features and coroner records."""
    path, coroner = _store(spark, FX.search_features(spark, sf_dir)), scratch.new_path(spark, "coroner")
    FS.write_coroner(FX.coroner(spark, sf_dir), coroner)
    d = FS.stored_feature_detail(spark, path, coroner, REPORT, 2024)
    return d.select("num_bo", "delegacia", "location_hash", "total_records", F.coalesce(F.array_join(F.transform("coroner", lambda c: c["id"].cast("string")), ","), F.lit("")).alias("coroner_ids"))

#: A block of 40 by 40 tiles of zoom 14.
TILES = (14, 6080, 9270, 6119, 9309)

def stored_tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6.16, O-10.1: tile points written in key order, and those of an envelope read."""
    path = scratch.new_path(spark, "points")
    TS.write_tile_points(FX.search_features(spark, sf_dir), path)
    p = TS.read_tile_points(spark, path, TS.envelope_of(*TILES), (2024,))
    return p.select("num_bo", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "location_hash", "category", "total_records", F.round("x_3857", 2).alias("x"), F.round("y_3857", 2).alias("y"))

def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-5.1, O-5.4 by states: customers of each nation as a file, of which some changed and one is gone, added up."""
    customer = FX.load(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")])
    before = customer.withColumn("c_acctbal", F.when(F.col("c_nationkey").cast("int") % 5 == 0, "x").otherwise(F.col("c_acctbal")))
    gone = before.withColumn("c_nationkey", F.lit("gone"))
    states = scratch.stored(profile.profile_states(before.unionByName(gone), F.col("c_nationkey")), "states")
    fresh = profile.profile_states(customer.where("cast(c_nationkey AS int) % 5 = 0"), F.col("c_nationkey"))
    away = states.where("file = 'gone'").select("file").distinct()
    got = profile.infer_type(profile.merge_states(profile.refresh_states(states, away, fresh)))
    return got.select("column", "null_count", "total_count", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), "numeric_min", "numeric_max", F.col("all_integer").cast("int").alias("all_integer"), "inferred_type")

def indexed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-7.2 from an index by category."""
    path = scratch.new_path(spark, "categories")
    CI.write_category_index(FX.search_features(spark, sf_dir), path)
    return CI.indexed_features(spark, path, (" Furto - click ", "Furto - view", "")).groupBy("category").agg(F.count(F.lit(1)).alias("count"))

def capped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10.5 with a cap that binds: two points to a tile, over the points of five tables at coarse places."""
    points = FE.build_tile_points(FX.search_features(spark, sf_dir))
    coarse = points.withColumns({c: F.floor(F.col(c) / 5000) * 5000 for c in ("x_3857", "y_3857")})
    return TI.raw_points(coarse, 16, most=2).select("num_bo", "location_hash", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "tile_x", "tile_y")

def merge_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8.21: rubrics and tables of a feature as one set."""
    f = FX.search_features(spark, sf_dir)
    return f.select("num_bo", "location_hash", F.coalesce("delegacia", F.lit("")).alias("delegacia"), F.array_join(F.array_sort(ST.merge_arrays(F.col("all_rubricas"), F.array_append("source_tables", F.col("category")))), "|").alias("merged"))

#: The report of the single lookups.
REPORT = "DU000009"

def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.3: one report at one unit, and at none."""
    f = FX.search_features(spark, sf_dir)
    both = LO.features_by_report(f, f" {REPORT} ", 2024, "DP 2").unionByName(LO.features_by_report(f, "DU000007", 2024, "")).unionByName(LO.features_by_report(f, REPORT, 2024, "dp 2"))
    return both.select("num_bo", F.coalesce("delegacia", F.lit("")).alias("delegacia"), "location_hash", "category", "total_records")

def report_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.4."""
    got = LO.summaries_by_report(FX.search_features(spark, sf_dir), REPORT)
    return got.select("num_bo", "ano_bo", "location_hash", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "category", "rubrica_for_styling", _text_date(F.col("data_ocorrencia")).alias("data_ocorrencia"), F.array_join("source_tables", "|").alias("source_tables"))

def feature_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.5: a report's first feature with the ids of its coroner records."""
    d = LO.feature_detail(FX.search_features(spark, sf_dir), FX.coroner(spark, sf_dir), REPORT, 2024)
    return d.select("num_bo", "delegacia", "location_hash", "total_records", F.coalesce(F.array_join(F.transform("coroner", lambda c: c["id"].cast("string")), ","), F.lit("")).alias("coroner_ids"))

def tile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9.7."""
    m = LO.tile_metadata(FX.search_features(spark, sf_dir))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"))), "|")
    return m.select(*[_text_date(F.col(c)).alias(c) for c in ("min_date", "max_date", "default_after")], "count", told("category_counts").alias("categories"), told("period_counts").alias("periods"))

def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.8: files that several categories share."""
    targets = FX.load(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("url"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category"))
    return IM.group_targets_by_file(targets).select("url", "year", F.array_join("categories", "|").alias("categories"))

def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.9: orders as downloads; some were never fetched."""
    files = FX.load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate")).alias("last_downloaded"))
    return IM.stale_files(files, 400, "1998-01-01").select("o_orderkey")

def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = FX.load(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))

def month_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.10: months of orders; some exports are empty, some hashes old, some months gone from the table."""
    m = _months(spark, sf_dir)
    fresh = m.select("year", "month", F.when(F.col("year") % 2 == 0, "a").otherwise("b").alias("file_hash"), F.when(F.col("month") == 3, 0).otherwise(F.col("n")).alias("rows"), (F.col("month") != 5).alias("present"))
    stored = m.where("month <> 7").select("year", "month", F.lit("a").alias("file_hash"))
    return IM.coroner_month_decision(m.where("month < 11").select("year", "month"), stored, fresh)

def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.11: the last write of each month holds."""
    m = _months(spark, sf_dir)
    old = m.where("month <= 8").select("year", "month", F.lit("old").alias("file_hash"), "n")
    new = m.where("month >= 6").select("year", "month", F.concat(F.lit("new"), F.col("n").cast("string")).alias("file_hash"), F.lit(1).cast("long").alias("n"))
    return IM.upsert_file_metadata(old, new, ["year", "month"])

def flagged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11.12: set for two tables, then cleared for one."""
    rows = reduce(DataFrame.unionByName, [R.source_rows(df, t) for t, df in FX.raw_tables(spark, sf_dir).items()])
    status = FE.etl_status(rows, list(FX.TABLES)).withColumn("needs_geom_update", F.col("rows_processed") < 0)
    flagged = IM.flag_tables_for_etl(IM.flag_tables_for_etl(status, ["celulares_2024", "objetos_2024"]), ["objetos_2024"], False)
    return flagged.select("source_table", F.col("needs_geom_update").cast("int").alias("needs_geom_update"))

QUERIES = {
    "o1_1_csv_round_trip": csv_round_trip,
    "o1_1_csv_in_splits": csv_in_splits,
    "o1_3_parquet_text": parquet_round_trip,
    "o1_5_merge": merge_tables,
    "o1_6_sample_rows": sample_rows,
    "o1_7_select_files": select_files,
    "o1_9_evolve_table": evolve_table,
    "o1_10_stable_ids": stable_ids,
    "o1_11_replace_month": replace_month,
    "o1_12_coroner_export": coroner_export,
    "o1_13_hash_files": hash_files,
    "o2_2_names_of_the_api": _renamed(("Id", "coluna@#$%especial", "  Ação   fim ", "x__y"), lambda df: df.toDF(*map(X.normalize_column_name_api, df.columns))),
    "o2_3_duplicates_that_differ": _renamed(("id", "Valor", "valor", "X"), schema.drop_identical_duplicate_columns),
    "o2_4_fix_names": _renamed(("id", "", "V", "v"), lambda df: df.toDF(*schema.fix_blank_and_duplicate_names(df.columns))),
    "o2_5_map_columns": _renamed(("Id", "Hora Fato", "DESCRICAO", "lost"), lambda df: schema.select_mapped(df, ["ID", "HORA_FATO", "descricao", "OTHER"])),
    "o2_6_type_overrides": _renamed(("ID", "QTDE (GRAMAS)", "HORA FATO", "X"), _typed),
    "o3_8_dates_and_times": _noisy(lambda: [_flag(f("v"), n) for n, f in (("is_date", V.is_date_format), ("is_time", V.is_time_format), ("is_timestamp", V.is_timestamp_format))]),
    "o3_13_checked_filter": _count("O-3.13", lambda: WHERE.checked().column()),
    "o4_3_excel_serials": _noisy(lambda: [_text_date(V.excel_serial_to_date(F.col("id") - 3)).alias("d"), V.excel_serial_legacy("v").alias("legacy")]),
    "o4_6_excel_cells": _noisy(lambda: [V.excel_datetime_cell(F.col("id") / 32, h).alias(n) for n, h in (("as_date", "DATA FATO"), ("as_time", "Hora"), ("as_text", "Valor"))]),
    "o4_16_flags_and_record_numbers": _noisy(lambda: [V.parse_record_number("concat('+', v)").alias("signed"), V.parse_record_number("concat(v, 'e2')").alias("scaled"), V.parse_source_flag("concat(v, chr(9))").cast("int").alias("flag"), X.source_text(F.concat(F.lit("\t"), F.col("v"), F.lit("\u00a0"))).alias("text")]),
    "o4_28_value_type": _noisy(lambda: [V.value_type_of("v").alias("value_type"), V.value_type_of(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"'))).alias("id_type")]),
    "o5_2_unique_counts": profile_uniques,
    "o5_3_float_grammar": profile_floats,
    "o6_6_other_records": other_records,
    "o6_14_refresh_known_tables": upsert_known,
    "o6_14_stored_refresh": stored_refresh,
    "o9_3_stored_reports": stored_reports,
    "o9_5_stored_detail": stored_detail,
    "o10_1_stored_tile_points": stored_tile_points,
    "o10_5_capped_points": capped_points,
    "o5_1_merged_profile": merged_profile,
    "o7_2_indexed_categories": indexed_categories,
    "o8_6_count_features": lambda spark, sf_dir: ST.count_features(FX.search_features(spark, sf_dir), WHERE),
    "o8_18_weapon_chart": weapon_chart,
    "o8_21_merge_arrays": merge_rubrics,
    "o9_3_report_at_a_unit": report_features,
    "o9_4_report_summaries": report_summaries,
    "o9_5_feature_detail": feature_detail,
    "o9_7_tile_metadata": tile_metadata,
    "o11_8_file_groups": file_groups,
    "o11_9_stale_files": stale_files,
    "o11_10_coroner_month_decisions": month_decisions,
    "o11_11_file_metadata": file_metadata,
    "o11_12_flagged_tables": flagged_tables,
    "o3_predicates": _noisy(lambda: [*[_flag(f("v"), n) for n, f in (("is_null", P.is_null_pattern), ("not_informed", P.is_not_informed), ("overflow", P.is_excel_overflow), ("zip", P.is_zip_code), ("dashed", P.is_dash_identifier), ("is_integer", P.is_valid_integer), ("is_numeric", P.is_valid_numeric), ("is_time", P.matches_time_pattern), ("descriptive", P.is_descriptive_text))]]),
    "o4_1_parse_date": _noisy(lambda: [_text_date(V.parse_date_flexible("v")).alias("d"), V.normalize_date_iso("v").alias("iso"), V.convert_excel_serial_if_needed("v").alias("serial")]),
    "o4_7_parse_time": _noisy(lambda: [V.parse_time_flexible("v").alias("t")]),
    "o4_8_clean_date": _noisy(lambda: [V.clean_date("v").alias("cleaned")]),
    "o4_9_clean_time": _noisy(lambda: [V.clean_time("v").alias("cleaned")]),
    "o4_10_clean_numeric": _noisy(lambda: [V.clean_numeric("v").alias("cleaned")]),
    "o4_11_clean_integer": _noisy(lambda: [V.clean_integer("v").alias("cleaned")]),
    "o4_12_clean_general": _noisy(lambda: [V.clean_general("v").alias("cleaned"), X.source_text("v").alias("source_text")]),
    "o4_14_parse_source_number": _noisy(lambda: [V.parse_source_number("v").alias("number"), V.parse_source_integer("v").alias("whole"), _flag(V.parse_source_flag("v"), "is_yes"), _flag(~V.parse_source_flag("v"), "is_no")]),
    "o4_17_parse_source_date": _noisy(lambda: [_text_date(V.parse_source_date("v")).alias("d")]),
    "o4_19_normalize_period": _noisy(lambda: [X.normalize_period("v").alias("period"), V.period_label(X.normalize_period("v")).alias("label"), V.period_sort(X.normalize_period("v")).alias("sort")]),
    "o4_21_occurrence_hour": _noisy(lambda: [V.occurrence_hour("v").alias("hour")]),
    "o4_24_lookup_key": _noisy(lambda: [X.normalize_lookup_key("v").alias("lookup_key"), X.normalize_text("v").alias("normalized_text"), X.normalize_name_column("v").alias("column_name")]),
    "o4_26_quantities": _noisy(lambda: [V.record_quantity("v").alias("quantity"), V.drug_grams("v").alias("grams")]),
    "o1_text_form": write_read_text,
    "o1_8_union_tables": evolve_and_union,
    "o5_1_profile_columns": profile_columns,
    "o5_6_prepare_table": prepare_table,
    "o6_9_group_features": group_features,
    "o6_11_merge_features": _flat_query(FX.TABLES),
    "o6_12_remove_source_table": remove_source_table,
    "o6_13_upsert_features": upsert_features,
    "o6_15_search_columns": search_columns,
    "o6_17_date_range": date_range,
    "o6_18_etl_status": etl_status,
    "o6_19_hydrate_records": hydrate,
    "o7_1_dates": _count("O-7.1", lambda: FI.date_filter("2024-01-05", "2024-01-20")),
    "o7_2_categories": _count("O-7.2", lambda: FI.category_filter((" Furto - click ", "Furto - view", ""))),
    "o7_3_periods": _count("O-7.3", lambda: FI.period_filter(("  À   TARDE  ", "pela manhã"))),
    "o7_4_hours": _count("O-7.4", lambda: FI.hour_filter(22, 5)),
    "o7_5_bounds": _count("O-7.5", lambda: FI.bounds_filter((-46.2, -23.2, -46.1, -23.1))),
    "o7_6_radius": _count("O-7.6", lambda: FI.radius_filter(-46.15, -23.12, 10_000)),
    "o7_7_tile_filter": _count("O-7.7", lambda: FI.tile_filter("2024-01-05", "2024-13-99", ("Furto - click",), (), ("22", None))),
    "o8_2_category_stats": category_stats,
    "o8_3_category_stats_for_location": category_stats_for_location,
    "o8_4_period_stats": period_stats,
    "o8_5_category_period_stats": category_period_stats,
    "o8_7_totals": totals,
    "o8_20_all_charts": all_charts,
    "o9_1_coroner_join": coroner_join,
    "o9_3_by_report": by_report,
    "o9_6_grouped_occurrences": grouped_occurrences,
    "o10_4_cluster_pyramid": cluster_pyramid,
    "o10_5_raw_points": raw_points,
    "o11_2_import_statistics": import_statistics,
    "o11_3_tables_needing_attention": attention,
    "o11_4_import_decisions": import_decisions,
    "o11_5_changed_files": changed_files,
    "o11_6_coroner_month_targets": month_targets,
}
