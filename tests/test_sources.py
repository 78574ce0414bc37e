"""Readers, schema mapping and profiles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from occspark.sources import io, profile, schema


def test_csv_keeps_repeated_headers_and_drops_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A;a;B\n1;1;"x;""y"""\n2;2\n3;3;z\n', encoding="utf-8")
    df = io.read_source_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["A", "a", "B"]
    assert sorted(map(tuple, df.collect())) == [("1", "1", 'x;"y"'), ("3", "3", "z")]
    assert sorted(map(tuple, schema.drop_identical_duplicate_columns(df).collect())) == [("1", 'x;"y"'), ("3", "z")]


def test_csv_cells_and_headers_hold_breaks_and_separators(spark, tmp_path):
    (tmp_path / "b.csv").write_text('A;B;C\n1;"x\ny";z\n2;b;c\n', encoding="utf-8")
    assert sorted(map(tuple, io.read_source_csv(spark, str(tmp_path / "b.csv")).collect())) == [("1", "x\ny", "z"), ("2", "b", "c")]
    (tmp_path / "c.csv").write_text('\ufeff"A;1";"B\n2"\nx;y\n', encoding="utf-8")
    df = io.read_source_csv(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["A;1", "B\n2"] and list(map(tuple, df.collect())) == [("x", "y")]


def test_stable_ids_follow_the_order(spark):
    df = spark.createDataFrame([(k * 37 % 101, k % 3) for k in range(101)], "a int, b int")
    got = sorted((r["id"], r["a"]) for r in io.with_stable_ids(df, ["a"]).collect())
    assert got == [(k + 1, k) for k in range(101)] and io.with_stable_ids(df.limit(0), ["a"]).count() == 0


def test_rows_reach_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(" a ", ""), ("b", None)], "X string, Y string")
    how = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    io.load_to_jdbc(df, url, "T1", properties=how)
    io.load_to_jdbc(df.limit(1), url, "T1", mode="append", properties=how)
    assert spark.read.jdbc(url, "T1", properties=how).where("Y is null").count() == 3


def test_scratch_folder_off_local_mode_must_be_named(spark, monkeypatch):
    from types import SimpleNamespace

    from occspark.sources import scratch

    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.shared_dir(elsewhere)


def test_duplicate_columns_that_differ_stay(spark):
    df = spark.createDataFrame([("1", "2", None), ("1", "1", " ")], "A string, b string, c string").toDF("N", "n", "C")
    assert schema.drop_identical_duplicate_columns(df).columns == ["N", "N_2", "C"]


def test_csv_and_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(" a ", ""), (None, "b;c")], "x string, y string")
    io.write_source_csv(df, str(tmp_path / "c"), quote_all=True)
    io.write_parquet_text(df, str(tmp_path / "p"))
    assert sorted(map(tuple, io.read_parquet_text(spark, str(tmp_path / "p")).collect())) == [("", "b;c"), ("a", "")]


def test_merge_needs_equal_headers(spark):
    a, b = spark.range(1).toDF("a"), spark.range(1).toDF("b")
    assert io.merge_tables([a, a]).count() == 2
    with pytest.raises(ValueError):
        io.merge_tables([a, b])


def test_files_and_sheets(spark):
    files = spark.createDataFrame([("DadosProdutividade_2024_Nº VEÍCULOS RECUPERADOS_2024.csv",), ("DadosProdutividade_2024_ARMAS.csv",), ("Metodologia.csv",)], "name string")
    assert io.select_files_for_category(files, ["VEÍCULOS RECUPERADOS"]).count() == 1
    assert files.where(io.is_data_sheet(F.col("name"))).count() == 2
    with pytest.raises(ValueError):
        io.select_files_for_category(files, ["nada"])


def test_columns():
    assert schema.fix_blank_and_duplicate_names(["a", "A", "", "a"]) == ["a", "A_2", "column_3", "a_3"]
    assert schema.map_columns(["Data Nascimento", "HORA FATO", "Descricao", "x"], ["DATA_NASCIMENTO", "HORA_FATO", "DESCRICAO"]) == {"Data Nascimento": "DATA_NASCIMENTO", "HORA FATO": "HORA_FATO", "Descricao": "DESCRICAO"}
    assert schema.apply_type_overrides({"Num BO": "INT", "x": "TEXT"}, {"NUM_BO": "TEXT", "gone": "INT"}) == {"Num BO": "TEXT", "x": "TEXT"}
    with pytest.raises(ValueError):
        schema.map_columns(["a"], ["b"])


def test_prepare_table(spark):
    df = spark.createDataFrame([("12,5", "DE MADRUGADA"), ("x", "14h30")], "q string, h string").toDF("QTDE (GRAMAS)", "HORA FATO")
    out, seen = profile.prepare_table(df, {"QTDE (GRAMAS)": "numeric", "HORA FATO": "TIME"})
    assert out.columns == ["QTDE_GRAMAS", "HORA_FATO"]
    assert sorted(map(tuple, out.collect())) == [("", "14:30"), ("12.5", "DE MADRUGADA")]
    assert seen.get["changed"] == 3


def test_profile_and_types(spark):
    df = spark.createDataFrame([(str(k), "2024-01-01", "null", f"{k}.5" if k else "NaN", "01234-000") for k in range(25)], "a string, d string, n string, f string, cep string")
    got = {r["column"]: r for r in profile.infer_type(profile.profile_columns(df)).collect()}
    assert {k: r["inferred_type"] for k, r in got.items()} == {"a": "SMALLINT", "d": "DATE", "n": "TEXT", "f": "NUMERIC", "cep": "TEXT"}
    assert got["n"]["null_count"] == 25 and got["a"]["numeric_max"] == 24.0 and got["d"]["max_length"] == 10


def test_coroner_export(spark, tmp_path):
    cells = ["01/02/2026 09:05:00", "2025", "AB-123", "01º D.P. - Mauá", "1", "2026", "30", "A", "c", "d", "Politraumatismo"]
    body = "\t".join(io.CORONER_INPUT) + "\r\n" + "\t".join(cells) + "\r\n" + "\t" * 10 + "\r\n"
    (tmp_path / "x.tsv").write_bytes(b"\xff\xfe" + body.encode("utf-16-le"))
    (row,) = io.read_coroner_export(spark, str(tmp_path / "x.tsv"), 2026, 2).collect()
    assert (row["NUM_BO_NORMALIZED"], row["DELEGACIA_REGISTRO_NORMALIZED"], row["MES_REFERENCIA"]) == ("AB 123", "01 D P MAUA", "02")
    with pytest.raises(ValueError):
        io.read_coroner_export(spark, str(tmp_path / "x.tsv"), 2026, 3)


def test_months_ids_and_hashes(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2025", "01"), ("2", "2025", "02")], "v string, ANO_REFERENCIA string, MES_REFERENCIA string")
    io.replace_month(rows, str(tmp_path / "m"))
    io.replace_month(rows.where("v = '2'").withColumn("v", F.lit("9")), str(tmp_path / "m"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "m")).collect()) == ["1", "9"]
    assert [r["id"] for r in io.with_stable_ids(rows, ["v"]).orderBy("v").collect()] == [1, 2]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    assert io.hash_files(spark, str(tmp_path / "f")).first()["sha256"].startswith("ba7816bf")
    assert io.replace_table([rows, rows], str(tmp_path / "t")) == 4


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_csv_is_read_by_many_tasks(spark, tmp_path, end):
    dice = random.Random(3)
    cells = ["", "a", "b c", '"q"', '""', '"x;y"', f'"l1{end}l2"', f'"{end}"', '"say ""hi"" now"', f'"""{end};""{end}"', 'in"side', '"ab"cd', " ", f'"{"w" * 90}{end}{"v" * 50}"']
    lines = ["K;L;M"] + [";".join([str(k), *dice.choices(cells, k=2 if dice.random() < 0.95 else dice.choice((1, 3)))]) for k in range(1500)]
    lines.insert(700, "")
    lines.insert(900, f'900000;"{end.join("line " + str(k) for k in range(900))}";over several splits')
    (tmp_path / "a.csv").write_bytes(end.join(["", *lines, ""]).encode())
    (tmp_path / "b.csv").write_bytes(end.join(["K;L;M", f'x;"y{end}{end}z";1', '"open;;']).encode())
    key = lambda r: tuple((x is not None, x or "") for x in r)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for path in (tmp_path / "a.csv", tmp_path):
        want = sorted(map(key, io.read_source_csv(spark, str(path)).collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
        try:
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
            got = io.read_source_csv(spark, str(path), split=True)
            assert got.columns == ["K", "L", "M"] and sorted(map(key, got.collect())) == want
            assert len(want) > 1300 and any(r[0][1] == "900000" for r in want)
            with pytest.raises(Exception, match="(?i)malformed"):
                io.read_source_csv(spark, str(path), strict=True, split=True).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_cells_are_cleaned_once(spark):
    from occspark.sources import profile

    out, _ = profile.prepare_table(spark.createDataFrame([("1,5",)], "Q string"), {"Q": "NUMERIC"})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[,.][,.]") == 1
    assert [tuple(r) for r in out.collect()] == [("1.5",)]
