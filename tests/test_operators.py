"""Features, filters, statistics, lookups, tiles and bookkeeping on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from occspark.operators import features as FE
from occspark.operators import filters as FI
from occspark.operators import imports as IM
from occspark.operators import lookups as LO
from occspark.operators import records as R
from occspark.operators import stats as ST
from occspark.operators import tiles as TI

BASE = "id bigint, NUM_BO string, ANO_BO string, LATITUDE string, LONGITUDE string, DATA_OCORRENCIA_BO string, NOME_DELEGACIA string, RUBRICA string, DESCR_PERIODO string, HORA_OCORRENCIA string, MARCA_OBJETO string, QUANTIDADE_OBJETO string, CIDADE string, NOME_MUNICIPIO string"


@pytest.fixture(scope="module")
def tables(spark):
    def table(*rows):
        return spark.createDataFrame([tuple(r) for r in rows], BASE)

    place = ("-23.551201401", "-46.634046855")
    return {
        "dados_criminais_2026": table((181952, "DU3509", "2026", "-23,551201", "-46,634047", "15/01/2026", "DEL.POL.METROPOLITANO", "Roubo (art. 157)", "A NOITE", "23:10", None, None, "São Paulo", None)),
        "objetos_2026": table((285443, "DU3509", "2026", *place, "31/12/2012", "DEL.POL.METROPOLITANO", "Roubo (art. 157)", "", "", "", "1", "", "Santos")),
        "celulares_2026": table((55554, "DU3509", "2026", *place, "", "DEL.POL.METROPOLITANO", "Furto", None, None, "Samsung", "2", None, None), (55553, "DU3509", "2026", *place, "", "DEL.POL.METROPOLITANO", "Furto", None, None, "Samsung", "x", None, None), (7, " ", "2026", *place, "", "x", "y", None, None, None, None, None, None), (8, "DU1", "2026", "-10", "-46", "", "x", "y", None, None, None, None, None, None)),
    }


@pytest.fixture(scope="module")
def built(tables):
    return FE.derive_search_columns(FE.build_features(tables)).cache()


def test_worked_feature(built):
    (row,) = built.collect()
    assert row["location_hash"] == "f4693e770c96dabb"
    assert [(r["type"], r["source_id"]) for r in row["records"]] == [("celular", 55553), ("celular", 55554), ("dados_criminais", 181952), ("objeto", 285443)]
    assert row["summary"].asDict() == {"total_records": 4, "celulares_count": 2, "veiculos_count": 0, "objetos_count": 1, "dados_criminais_count": 1, "produtividade_count": 0}
    assert row["category"] == "Roubo (art. 157)" and str(row["data_ocorrencia"]) == "2026-01-15"  # the last table's date is too early
    assert row["location"]["cidade"] == "Santos" and row["all_rubricas"] == ["Furto", "Roubo (art. 157)"]
    assert (row["periodo_normalized"], row["hora_ocorrencia"], row["total_records"]) == ("a noite", 23, 4)
    assert row["search_categories"][-1] == row["category"] and row["source_tables"] == ["celulares_2026", "dados_criminais_2026", "objetos_2026"]


def test_rebuild_equals_refresh_and_removal(tables):
    whole = FE.build_features(tables)
    first = FE.build_features({"celulares_2026": tables["celulares_2026"]})
    refreshed = FE.incremental_refresh(first, tables, ["objetos_2026", "dados_criminais_2026"])
    told = lambda df: df.select(*sorted(df.columns)).collect()
    assert told(refreshed) == told(whole.select(*refreshed.columns))
    (rest,) = FE.remove_source_table(whole, "celulares_2026").collect()
    assert rest["summary"]["total_records"] == 2 and rest["all_rubricas"] == ["Roubo (art. 157)"]
    assert FE.remove_source_table(first, "celulares_2026").count() == 0


def test_configs_and_errors(spark, tables):
    assert R.source_config("produtividade_veiculos_recuperados_2020").record_type == "produtividade_veiculos"
    assert R.source_config("veiculos_2020").record_type == "veiculo" and R.source_config("x") is None
    with pytest.raises(ValueError):
        R.select_needed(tables["objetos_2026"].drop("RUBRICA"), R.source_config("objetos"))
    people = spark.createDataFrame([(1, "Branca", "34")], "id bigint, COR_CURTIS string, IDADE_PESSOA string")
    got = people.select(R.extract_record(people, R.source_config("produtividade_presos_2024"), "t").alias("r")).first()["r"]
    assert (got["cor"], got["idade"]) == ("Branca", 34)
    drugs = spark.createDataFrame([(42, "1.234,56")], "id bigint, QTDE_GRAMAS_ARRED string")
    assert drugs.select(R.extract_record(drugs, R.source_config("produtividade_entorpecentes"), "t").alias("r")).first()["r"]["quantidade_gramas"] == 1234.56


def test_filters(built):
    count = lambda **k: built.where(FI.FeatureFilter(**k).checked().column()).count()
    assert count(after="2026-01-15", before="2026-01-15") == 1 and count(after="2026-01-16") == 0
    assert count(categories=(" Furto ", "")) == 1 and count(periods=("  À   NOITE ",)) == 1 and count(hour_start=22, hour_end=3) == 1
    assert count(bounds=(-46.7, -23.6, -46.6, -23.5)) == 1
    assert built.where(FI.radius_filter(-46.634, -23.551, 100, sphere=True)).count() == 1
    assert built.where(FI.tile_filter(after="x", hours=("3", None))).count() == 1
    for bad in ({"after": "2026-02-30"}, {"after": "2026-02-02", "before": "2026-01-01"}, {"hour_start": 1}, {"hour_start": 1, "hour_end": 24}, {"bounds": (1, 0, 0, 1)}):
        with pytest.raises(ValueError):
            FI.FeatureFilter(**bad).checked()
    with pytest.raises(ValueError):
        FI.check_radius(0)


def test_statistics(built):
    assert [tuple(r) for r in ST.category_stats(built).collect()] == [("Furto", 1, "Furto", "rubrica"), ("Roubo (art. 157)", 1, "Roubo (art. 157)", "rubrica")]
    assert [tuple(r) for r in ST.chart(built, "phone_brand").collect()] == [(1, "Samsung", 2, 3.0)]
    assert {r["chart"] for r in ST.all_charts(built).collect()} == {"category", "period", "weekday", "record_type", "object_type", "phone_brand", "location_type", "police_circumscription", "police_unit"}
    assert tuple(ST.totals(built).first()) == (1, 4)
    assert LO.tile_metadata(built).first()["count"] == 1


def test_lookups(spark, built):
    coroner = spark.createDataFrame([(2, "iml", "du 3509", "2026", "DEL POL METROPOLITANO", ""), (1, "iml", "DU-3509", "2026", "del.pol.metropolitano", "01/02/2026 09:05:00")], "id bigint, source_table string, NUM_BO string, ANO_BO string, DELEGACIA_REGISTRO string, DATA_ENTRADA_IML string")
    plain = built.withColumn("num_bo", F.lit("DU 3509"))
    (row,) = LO.coroner_join(plain, coroner).collect()
    assert [c["id"] for c in row["coroner"]] == [1, 2]
    assert LO.feature_detail(built, coroner, "DU3509").count() == 1 and LO.summaries_by_report(built, " DU3509 ", 2025).count() == 0
    assert LO.grouped_occurrences(built.withColumn("records", F.filter("records", lambda r: F.lit(False)))).count() == 1
    assert sorted(r["occurrence_id"] for r in LO.grouped_occurrences(built).collect())[0] == "celulares_2026:55553"


def test_tiles(built):
    points = FE.build_tile_points(built)
    twice = points.unionByName(points.withColumn("num_bo", F.lit("other")))
    got = TI.cluster_pyramid(twice).collect()
    assert len(got) == 6 and all(r["cluster_count"] == 2 and r["is_cluster"] and r["num_bo"] is None for r in got)
    assert TI.cluster_points(points, 12).first()["num_bo"] == "DU3509"
    assert TI.raw_points(twice, 16, ("Furto",), most=1).count() == 1
    with pytest.raises(ValueError):
        TI.raw_points(points, 12)


def test_import_bookkeeping(spark):
    cat = spark.createDataFrame([("a", 2025), ("a", 2026), ("a", 2024), ("b", 2024)], "category string, year int")
    counts = spark.createDataFrame([("a", 2025, 5), ("a", 2026, 5), ("a", 2024, 0)], "category string, year int, rows int")
    stored = spark.createDataFrame([("a", 2025, "x"), ("a", 2026, "x")], "category string, year int, file_hash string")
    fresh = spark.createDataFrame([("a", 2025, "y"), ("a", 2026, "x")], "category string, year int, file_hash string")
    told = lambda day: {(r["category"], r["year"]): r["reason"] for r in IM.import_decisions(IM.import_status(cat, counts), stored, fresh, day).collect()}
    assert told("2026-03-15") == {("a", 2025): "past", ("a", 2026): "unchanged", ("a", 2024): "empty", ("b", 2024): "missing"}
    assert told("2026-01-15")[("a", 2025)] == "changed"
    assert [r["year"] for r in IM.changed_files(stored, fresh, ["category", "year"]).collect()] == [2025]
    targets = spark.createDataFrame([("u", "a", 2024), ("u", "b", 2024), ("v", "c", 2026)], "url string, category string, year int")
    assert [r["url"] for r in IM.group_targets_by_file(targets).collect()] == ["u", "v"]
    assert IM.upsert_file_metadata(stored, fresh, ["category", "year"]).where("file_hash = 'y'").count() == 1
    months = spark.sql("select explode(sequence(date'2013-01-01', date'2026-06-01', interval 1 month)) d").selectExpr("year(d) year", "month(d) month")
    now = spark.sql("select date'2026-06-14' as now")
    assert sorted(r["month"] for r in IM.coroner_month_targets(now, months, months).collect()) == [4, 5, 6]
    assert sorted(r["month"] for r in IM.coroner_month_targets(now, months.where("not (year = 2026 and month = 3)"), months).collect()) == [3, 4, 5, 6]
    status = spark.createDataFrame([("t", False)], "source_table string, needs_geom_update boolean")
    assert IM.flag_tables_for_etl(status, ["t"]).first()["needs_geom_update"]
    files = spark.createDataFrame([("a", "2026-01-01 00:00:00")], "f string, d string").select("f", F.col("d").cast("timestamp").alias("last_downloaded"))
    assert IM.stale_files(files, 30, "2026-03-01").count() == 1 and IM.stale_files(files, 90, "2026-03-01").count() == 0
    month = spark.createDataFrame([(2026, 5)], "year int, month int")
    got = lambda rows, h: IM.coroner_month_decision(month, month.withColumn("file_hash", F.lit("x")), month.withColumns({"file_hash": F.lit(h), "rows": F.lit(rows), "present": F.lit(True)})).first()["action"]
    assert (got(0, "x"), got(5, "x"), got(5, "z")) == ("error", "unchanged", "replace")


def test_rows_of_one_row_group_are_dealt_to_several_tasks(spark, tmp_path):
    from occspark.plans import fixtures as FX

    spark.range(100_000).selectExpr("id AS event_id", "'view' AS event_type", "timestamp'2024-01-05 10:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with_plan = FX.noisy(spark, str(tmp_path))
    assert "Exchange hashpartitioning(event_id" in with_plan._jdf.queryExecution().executedPlan().toString()
    assert with_plan.count() == 100_000


def test_features_of_rows_need_one_aggregation(spark):
    raw = [(k, f"B{k // 4}", "2024", (" -23.5", "-23,5000001", "-23.5")[k % 3], "-46.6", ("2024-01-05", "31/02/2024", "45291.5", None)[k % 4], ("", "DP 1")[k // 8 % 2], (None, "Furto", "Roubo")[k % 3], (" ", "Via 1")[k % 2], ("S", "talvez")[k % 2]) for k in range(40)]
    df = spark.createDataFrame(raw, "id long, NUM_BO string, ANO_BO string, LATITUDE string, LONGITUDE string, DATA_OCORRENCIA_BO string, NOME_DELEGACIA string, RUBRICA string, DESCR_TIPOLOCAL string, FLAG_FLAGRANTE string")
    rows = R.source_rows(df.where("id % 5 < 3"), "celulares_2024").unionByName(R.source_rows(df.where("id % 5 > 1"), "veiculos_2024"))
    whole = FE.features_of_rows(rows)
    stepwise = FE.merge_features(FE.group_features(rows))
    assert whole.columns == stepwise.columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, stepwise.collect()))
    plan = lambda features: features._jdf.queryExecution().executedPlan().toString()
    assert plan(FE.build_features({"celulares_2024": df})).count("ObjectHashAggregate") == 2 < plan(stepwise).count("ObjectHashAggregate")


def test_features_of_some_fields_and_one_chart(tables, built):
    few = FE.build_features(tables, (*FE.SEARCHED, "record.marca"))
    assert few.schema["occurrence"].dataType.names == ["hora_ocorrencia", "periodo"] and "location" not in few.columns
    assert {*few.schema["records"].dataType.elementType.names} == {"type", "source_table", "rubrica", "marca"}
    whole = FE.build_features(tables)
    plain = lambda df: [tuple(r) for r in df.select(*R.KEY, "category", "data_ocorrencia", "occurrence.periodo", "all_rubricas", "source_tables", "summary", F.transform("records", lambda r: r["marca"])).orderBy(*R.KEY).collect()]
    assert plain(few) == plain(whole)
    with pytest.raises(ValueError):
        FE.build_features(tables, ("record.nothing",))
    phones = ST.chart(built, "phone_brand")
    assert "drug_type" not in phones._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        ST.chart(built, "nothing")


def test_costly_rows_are_dealt_to_several_tasks_a_core(spark):
    from occspark.plans import fixtures as FX

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert FX.dealt_to(spark) == 32
        assert FX.noisy(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
