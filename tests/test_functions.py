"""Exact input and output pairs of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from occspark.functions import geo
from occspark.functions import patterns as P
from occspark.functions import text as X
from occspark.functions import values as V

_date = lambda f: lambda c: F.date_format(f(c), "yyyy-MM-dd")

PAIRS = [
    (V.clean_date, {"15/01/2024": "2024-01-15", "15-01-2024": "2024-01-15", "31/12/2012": "", "01/01/2013": "2013-01-01", "0182-12-06": "", "41274": "", "41275": "2013-01-01", "44927": "2023-01-01", "45292.0": "2024-01-01", "45292.5": "2024-01-01", "2024-01-15 10:30:00": "2024-01-15", "REGISTRADO NA PF": "", "": "", None: ""}),
    (V.is_date_format, {"01/15/2024": True, "2024/01/15": False}),
    (V.clean_time, {"14:30": "14:30", "14:30:45": "14:30:45", "14h30": "14:30", "1430": "14:30", "230": "02:30", "0.25": "06:00:00", "########": "", "9:05": "9:05"}),
    (V.parse_time_flexible, {"0.5074652777777778": "12:10:45", "invalid": None, "25:00": None, "0": "00:00:00", "1.5": "01:05", "23h30": "23:30", "23.30": "23:30"}),
    (V.clean_numeric, {"123,45": "123.45", "-22,.8": "-22.8", "12..34": "12.34", "12.": "12", "########": "", "  ": "", "1.234,56": "1.234"}),
    (V.clean_integer, {"-12345": "-12345", "12345-678": "12345-678", "123-456-789": "123-456-789", "-": "", "########": "", "12.5": "125"}),
    (V.clean_general, {"  hello  ": "hello", "NÃO INFORMADO": "", "nao informado": "", "nullnull": ""}),
    (P.is_null_pattern, {"NULL": True, "nullnull": True, "NULLVALUE": False, "": False}),
    (V.parse_source_number, {"12,5": 12.5, "1.234,56": 1234.56, "-23,5505": -23.5505, "1,234.56": 1234.56, "x": None, "1d": None}),
    (V.parse_source_integer, {"2026.0": 2026, "": None, "-1,9": -1}),
    (V.parse_source_flag, {"S": True, "N": False, "": None}),
    (_date(V.parse_source_date), {"15/01/2024": "2024-01-15", "45292.5": "2024-01-01", "31/02/2024": None, "15/01/2024 10:00": "2024-01-15", "2024-01-15T10:00": "2024-01-15"}),
    (V.occurrence_hour, {"23:10": 23, "9": 9, "24:00": None, "30:00": None}),
    (X.normalize_period, {"  À   TARDE  ": "a tarde", "PELA MANHÃ": "pela manha", " ": None}),
    (X.normalize_lookup_key, {"01º D.P. - Mauá": "01 D P MAUA", "AB-123": "AB 123"}),
    (V.value_type_of, {"15/01/2024": "DATE", "14:30": "TIME", "12": "SMALLINT", "70000": "INT", "99999999999": "BIGINT", "1,5": "FLOAT", "x": "TEXT"}),
    (V.excel_serial_legacy, {"45292": "2024-01-01", "15/01/2024": "15/01/2024", "7": "7"}),
    (V.convert_excel_serial_if_needed, {"44927": "2023-01-01", "abc": "abc", "41274": "41274"}),
    (V.is_timestamp_format, {"2024-01-15 10:30:00": True, "2024-13-15 10:30:00": False, "2024-01-15": False}),
    (P.is_descriptive_text, {"DE MADRUGADA": True, "14:30": False, "abc": True, "1234": False}),
    (V.period_label, {"a tarde": "À tarde", "turno": "Turno"}),
    (V.record_type_label, {"celular": "Celulares", "novo": "novo", "": "Não informado"}),
    (V.record_quantity, {"3": 3, "x": 1}), (V.drug_grams, {"1,5": 1.5, "-1": 0.0}),
]


@pytest.mark.parametrize(("function", "pairs"), PAIRS)
def test_pairs(spark, function, pairs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(pairs)], "k int, v string")
    got = {r["v"]: r["got"] for r in df.select("v", function("v").alias("got")).collect()}
    assert got == pairs


def test_names():
    assert X.normalize_column_name("  múltiplas   espaços  ") == "MULTIPLAS_ESPACOS"
    assert X.normalize_column_name("coluna@#$%especial") == "COLUNAESPECIAL"
    assert X.normalize_column_name_api("coluna@#$%especial") == "COLUNA_ESPECIAL"


def test_places(spark):
    df = spark.createDataFrame([(-23.551201, -46.634047)], "lat double, lon double")
    row = df.select(V.location_hash("lat", "lon").alias("h"), geo.haversine_m("lat", "lon", F.lit(-23.55), F.lit(-46.63)).alias("m"), geo.geodesic_m(F.col("lat"), F.col("lon"), F.lit(-23.55), F.lit(-46.63)).alias("g"), V.location_bucket("-23.55005").cast("string").alias("b")).first()
    assert row["h"] == "f4693e770c96dabb"
    assert abs(row["m"] - row["g"]) < 3 and 400 < row["m"] < 450
    assert row["b"] == "-23.5501"


def test_excel_cells(spark):
    df = spark.createDataFrame([(45292.5,)], "x double")
    assert tuple(df.select(V.excel_datetime_cell("x", "DATA"), V.excel_datetime_cell("x", "HORA"), V.excel_datetime_cell("x", "N")).first()) == ("2024-01-01", "12:00:00", "45292.5")


def test_ellipsoid_in_the_jvm_equals_the_iterated_one(spark):
    import numpy as np

    dice = np.random.default_rng(1)
    lat1, lon1 = dice.uniform(-25, -19, 200), dice.uniform(-54, -44, 200)
    lat2, lon2 = lat1 + dice.uniform(-0.09, 0.09, 200), lon1 + dice.uniform(-0.09, 0.09, 200)
    lat2[0], lon2[0] = lat1[0], lon1[0]
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(lat1, lon1, lat2, lon2, strict=True)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(geo.ellipsoid_m("a", "b", "c", "d")).collect()]
    assert np.abs(np.array(got) - geo.vincenty_m(lat1, lon1, lat2, lon2)).max() < 0.03 and got[0] == 0


def test_all_white_space_is_trimmed_and_record_numbers_are_loose(spark):
    df = spark.createDataFrame([("S\t",), ("\u00a0+5\n",), (".5",), ("1e3",), ("5.",), ("",), (None,)], "v string")
    got = df.select(V.parse_source_flag("v"), V.parse_source_number("v"), V.parse_record_number("v")).collect()
    assert [r[0] for r in got] == [True, None, None, None, None, None, None]
    assert [r[1] for r in got] == [None] * 7 and [r[2] for r in got] == [None, 5.0, 0.5, 1000.0, 5.0, None, None]


def test_years_past_9999_have_no_sign(spark):
    df = spark.createDataFrame([(45292,), (2958465,), (2958466,), (6000000,)], "n int")
    assert [r[0] for r in df.select(V.iso(V.excel_serial_to_date("n"))).collect()] == ["2024-01-01", "9999-12-31", "10000-01-01", "18327-06-10"]


@pytest.mark.parametrize("function", [V.value_type_of, V.clean_time, V.clean_numeric, V.clean_date, P.is_descriptive_text])
def test_a_value_is_trimmed_once(spark, function):
    plan = spark.createDataFrame([("1",)], "v string").select(function("v").alias("got"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(v") == 1 and len(plan) < 20_000


def test_usual_cells_are_read_as_any_others(spark):
    """Cells that are read at once, and those just beside them, which are left to the general rules."""
    numbers = {"12": 12.0, "-1,5": -1.5, "1.": None, "12\n": 12.0, "12\u0085": 12.0, " 12": 12.0, "1,2,3": None, "": None, None: None}
    days = {"2024-02-29": "2024-02-29", "2023-02-29": None, "2024-01-05 x": "2024-01-05", "2024-01-05x": None, "05-01-2024": "2024-01-05", "05-01-2024 ": "2024-01-05", "05-01-2024 x": None, "5/1/2024": "2024-01-05",
            "05/01/2024x": "2024-01-05", "31/12/0000": "0000-12-31", "41274": None, "73050.999999": "2099-12-31", "45291.99999999999999999": "2024-01-01", "": None, None: None}
    texts = {"á": "á", " x": "x", "x\n": "x", "x\ny": "x\ny", "　": None, "": None, "º x º": "º x º", "x\u0085": "x\u0085", None: None}
    for of, pairs in ((V.parse_source_number, numbers), (_date(V.parse_source_date), days), (lambda c: F.expr(X.text_sql(c)), texts), (V.parse_source_flag, {"S": True, " s": True, "não": False, "NÃO": False, "N ": False, "": None, None: None})):
        df = spark.createDataFrame([(v,) for v in pairs], "v string")
        got = {r["v"]: r["got"] for r in df.select("v", of("v").alias("got")).collect()}
        assert got == pairs
