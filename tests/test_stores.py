"""Tables replaced in one step, feature stores and tile points: what is right, what is read, what a failure leaves."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from occspark.functions import geo
from occspark.operators import category_index as CI
from occspark.operators import feature_store as FS
from occspark.operators import features as FE
from occspark.operators import filters as FI
from occspark.operators import lookups as LO
from occspark.operators import tile_store as TS
from occspark.operators import tiles as TI
from occspark.sources import io, profile
from occspark.sources import versions as VS

RAW = "id bigint, NUM_BO string, ANO_BO string, LATITUDE string, LONGITUDE string, DATA_OCORRENCIA_BO string, NOME_DELEGACIA string, RUBRICA string, DESCR_PERIODO string, HORA_OCORRENCIA string, MARCA_OBJETO string, QUANTIDADE_OBJETO string, CIDADE string"


def raw(spark, rows):
    """Rows (id, report, year, rubric, brand)."""
    return spark.createDataFrame([(i, f"DU{n}", str(y), f"-23.{500000 + n}", f"-46.{600000 + n}", f"{1 + n % 28:02d}/01/{y}", "DP", r, "A NOITE", "23:10", b, "1", "x") for i, n, y, r, b in rows], RAW)


@pytest.fixture(scope="module")
def tables(spark):
    first = [(k, k % 150, 2023 + k % 2, f"r{k % 3}", "b") for k in range(300)]
    return {"celulares_2024": raw(spark, first), "objetos_2024": raw(spark, [(k, k, 2023, "o", "c") for k in range(0, 150, 2)]), "veiculos_2024": raw(spark, [(k, n, 2023, "v", None) for k, n in enumerate((3, 5, 999))])}


def told(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df.select(*columns).collect()))


def scanned(df):
    """Rows that the scan of a frame gives on, as it counts them."""
    df.collect()
    nodes, rows = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return rows


def test_refresh_reads_and_writes_what_it_touches(spark, tables, tmp_path):
    path = str(tmp_path / "s")
    whole = FE.build_features(tables).cache()
    assert FS.write_features(whole, path, buckets=100) == whole.count()
    before = VS.listed(spark, path)
    # one report changes, one goes, one is new
    fresh = {"veiculos_2024": raw(spark, [(0, 3, 2023, "w", None), (9, 1000, 2024, "v", None)])}
    touched = FS.refresh_store(spark, path, fresh, ["veiculos_2024", "gone_2024"])
    after = VS.listed(spark, path)
    assert set(touched) < set(before.parts) | set(after.parts) and 2 <= len(touched) <= 4 < len(before.parts) // 20
    assert all(after.parts[n] == p for n, p in before.parts.items() if n not in touched)
    assert all(after.parts[n].folder != before.parts[n].folder for n in touched if n in before.parts and n in after.parts)
    assert told(FS.read_features(spark, path)) == told(FE.incremental_refresh(whole, fresh, ["veiculos_2024"]))
    assert FS.refresh_store(spark, path, fresh, ["gone_2024"]) == {} and VS.listed(spark, path).number == 2
    # a part that holds nothing any more isn't listed
    assert 0 in FS.refresh_store(spark, path, {"veiculos_2024": fresh["veiculos_2024"].limit(0)}, ["veiculos_2024"]).values()
    left = told(FS.read_features(spark, path))
    assert VS.remove_unlisted(spark, path) > 0 and told(FS.read_features(spark, path)) == left


def test_refresh_keeps_search_columns(spark, tables, tmp_path):
    path = str(tmp_path / "s")
    FS.write_features(FE.derive_search_columns(FE.build_features(tables)), path, buckets=8)
    FS.refresh_store(spark, path, tables, ["objetos_2024"])
    want = FE.derive_search_columns(FE.incremental_refresh(FE.build_features(tables), tables, ["objetos_2024"]))
    assert told(FS.read_features(spark, path)) == told(want)


def test_lookups_read_one_folder_and_few_rows(spark, tmp_path):
    features = FE.derive_search_columns(FE.build_features({"celulares_2024": raw(spark, [(k, k, 2023 + k % 2, "r", "b") for k in range(4_000)])})).cache()
    path = str(tmp_path / "s")
    FS.write_features(features, path, buckets=2, row_group=1 << 16)
    for number, year in (("DU77", 2024), ("DU78", None), ("DU9", 1999), ("DUx", None)):
        got = FS.stored_features_by_report(spark, path, f" {number} ", year)
        assert told(got) == told(LO.features_by_report(features, number, year))
        assert len(got.inputFiles()) <= (1 if year else 2)
    one = FS.stored_summaries_by_report(spark, path, "DU77", 2024)
    folder = next(p for p in VS.listed(spark, path).parts.values() if f"/{p.name}/" in one.inputFiles()[0])
    assert one.count() == 1 and 0 < scanned(one) < folder.rows // 2  # one row group
    absent = FS.stored_summaries_by_report(spark, path, "DU77x", 2024)
    assert absent.count() == 0 and scanned(absent) == 0  # the Bloom filter knows
    keys = spark.createDataFrame([("DU5", 2024), ("DU8", None), ("none", 2023)], "num_bo string, ano_bo int")
    assert told(FS.stored_features_by_reports(spark, path, keys)) == told(LO.features_by_reports(features, keys))
    coroner = spark.createDataFrame([(k, "iml", f" du-{k}", "2024", "dp", "01/02/2024") for k in range(50)], "id bigint, source_table string, NUM_BO string, ANO_BO string, DELEGACIA_REGISTRO string, DATA_ENTRADA_IML string")
    spaced = features.withColumn("num_bo", F.regexp_replace("num_bo", "DU", "DU "))
    FS.write_features(spaced, str(tmp_path / "t"), buckets=4)
    FS.write_coroner(coroner, str(tmp_path / "c"), buckets=10)
    got = FS.stored_feature_detail(spark, str(tmp_path / "t"), str(tmp_path / "c"), "DU 7", 2024)
    assert told(got) == told(LO.feature_detail(spaced, coroner, "DU 7", 2024)) and [c["id"] for c in got.first()["coroner"]] == [7]


def test_keys_of_tiles_are_ranges(spark):
    dice = random.Random(4)
    points = [(dice.uniform(-5.3e6, -5.1e6), dice.uniform(-2.75e6, -2.6e6)) for _ in range(200)]
    frame = spark.createDataFrame(points, "x double, y double")
    at = {z: geo.tile_xy("x", "y", F.lit(z)) for z in (10, 14, 22)}
    rows = frame.select("x", "y", TS.quadkey("x", "y").alias("key"), *[c.alias(f"{n}{z}") for z, xy in at.items() for n, c in zip("xy", xy, strict=True)]).collect()
    for r in rows:
        for z in at:
            first, last = TS.tile_range(z, r[f"x{z}"], r[f"y{z}"])
            assert first <= r["key"] <= last
        x0, y0, x1, y1 = TS.envelope_of(14, r["x14"], r["y14"])
        assert x0 <= r["x"] <= x1 and y0 <= r["y"] <= y1
    for most in (4, 16, 64):
        for _ in range(40):
            (ax, ay), (bx, by) = dice.sample(points, 2)
            box = min(ax, bx), min(ay, by), max(ax, bx), max(ay, by)  # points lie on its edges
            ranges = TS.cover(box, most)
            assert len(ranges) <= most and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
            for r in rows:
                if box[0] <= r["x"] <= box[2] and box[1] <= r["y"] <= box[3]:
                    assert any(a <= r["key"] <= b for a, b in ranges)


def test_tile_points_files_grow_and_envelopes_read_few(spark, tmp_path):
    n = 6_000
    base = FE.derive_search_columns(FE.build_features({"celulares_2024": raw(spark, [(1, 1, 2024, "r", "b")])}))
    many = base.crossJoin(spark.range(n).withColumnRenamed("id", "k")).withColumns({"num_bo": F.concat("num_bo", F.col("k").cast("string")), "x_3857": F.lit(-5.2e6) + F.pmod(F.col("k") * 7919, F.lit(n)) * 20, "y_3857": F.lit(-2.7e6) + F.pmod(F.col("k") * 104729, F.lit(n)) * 20}).drop("k").cache()
    few, more = str(tmp_path / "few"), str(tmp_path / "more")
    assert TS.write_tile_points(many, few, file_rows=n) == TS.write_tile_points(many, more, file_rows=n // 12) == n
    files = [len(TS.read_tile_points(spark, p).inputFiles()) for p in (few, more)]
    assert files[1] >= files[0] + 8  # one year, many tasks
    point = many.first()
    x, y = (int(v) for v in spark.range(1).select(*geo.tile_xy(F.lit(point["x_3857"]), F.lit(point["y_3857"]), F.lit(16))).first())
    box = TS.envelope_of(16, x, y)
    got = TS.read_tile_points(spark, more, box, (2024,))
    want = FE.build_tile_points(many).where(F.col("x_3857").between(box[0], box[2]) & F.col("y_3857").between(box[1], box[3]))
    assert told(got) == told(want) and got.count() > 0
    assert len(got.inputFiles()) < files[1] and scanned(got) < n // 4
    assert TS.read_tile_points(spark, more, box, (1999,)).count() == 0 and told(TS.read_tile_points(spark, more)) == told(FE.build_tile_points(many))


def test_pyramid_is_made_of_the_finest_grids(spark):
    dice = random.Random(8)
    rows = [(f"n{k}", 2024, "d", "h", None, -5.2e6 + dice.random() * 2e5, -2.7e6 + dice.random() * 2e5, f"c{k % 5}") for k in range(400)]
    points = spark.createDataFrame(rows, "num_bo string, ano_bo int, delegacia string, location_hash string, data_ocorrencia date, x_3857 double, y_3857 double, category string")
    assert TI._bases(TI.CELLS) == {10: 15, 11: 14, 12: 15, 13: 15, 14: 14, 15: 15}
    rounded = lambda df: told(df.withColumns({"x": F.round("x", 3), "y": F.round("y", 3)}))
    alone = TI.cluster_points(points, 10)
    for zoom in range(11, 16):
        alone = alone.unionByName(TI.cluster_points(points, zoom))
    assert rounded(TI.cluster_pyramid(points)) == rounded(alone)
    assert TI.cluster_pyramid(points).groupBy("zoom").agg(F.sum("cluster_count").alias("n")).where("n = 400").count() == 6


def test_full_tiles_send_their_first_points(spark):
    points = spark.range(3_000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("num_bo"), F.lit(2024).alias("ano_bo"), F.lit("d").alias("delegacia"), F.lit("h").alias("location_hash"), F.lit("c").alias("category"), F.lit(1).alias("total_records"), (F.lit(-5.2e6) + F.col("id") * 1e-4).alias("x_3857"), (F.lit(-2.7e6) + F.col("id") * 1e-4).alias("y_3857"))
    got = TI.raw_points(points.repartition(3), 16, most=2_000)
    assert sorted(r["num_bo"] for r in got.collect()) == [f"n{k:05d}" for k in range(2_000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).withColumn("v", F.lit("a"))
    assert io.replace_table([rows, rows], path) == 20
    broken = rows.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        io.replace_table([broken], path)
    assert io.read_table(spark, path).count() == 20 and spark.read.parquet(path).count() == 20
    stale = VS.listed(spark, path)
    VS.replace_all(rows, path)
    with pytest.raises(RuntimeError):
        VS.publish(spark, path, stale, rows.schema, [], {})
    assert io.read_table(spark, path).count() == 10
    assert io.replace_table([rows.limit(0)], path) == 0 and io.read_table(spark, path).columns == ["id", "v"]


def test_plain_files_of_a_table_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    assert io.replace_table([spark.range(3)], path) == 3 and spark.read.parquet(path).count() == 3


def test_a_large_month_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit("2025").alias("ANO_REFERENCIA"), F.when(F.col("id") < 10, "01").otherwise("02").alias("MES_REFERENCIA"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        io.replace_month(rows.repartition(6), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = io.read_table(spark, path).inputFiles()
    assert sum("MES_REFERENCIA=02" in f for f in files) > 1
    io.replace_month(rows.where("MES_REFERENCIA = '01'").limit(3), path)
    got = {r["MES_REFERENCIA"]: r["count"] for r in io.read_table(spark, path).groupBy("MES_REFERENCIA").count().collect()}
    assert got == {"01": 3, "02": 39_990}


def test_files_reach_a_database_together_or_not_at_all(spark, tmp_path):
    url, how = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    first = spark.createDataFrame([(" a ", "1"), ("b", "")], "X string, N string")
    with io._connection(spark, url, how) as connection:
        connection.createStatement().executeUpdate('CREATE TABLE T2 ("X" VARCHAR(20), "N_BO" INTEGER, "KIND" VARCHAR(9) DEFAULT \'old\')')
    named = first.toDF("x", "N BO")
    assert io.load_to_jdbc([named, spark.createDataFrame([("c", "new", "?")], "X string, KIND string, EXTRA string")], url, "T2", properties=how) == 3
    read = lambda: sorted(map(tuple, spark.read.jdbc(url, "T2", properties=how).collect()), key=repr)
    assert read() == [("a", 1, "old"), ("b", None, "old"), ("c", None, "new")]
    bad = spark.createDataFrame([("d", "much too long for it")], "X string, KIND string")
    with pytest.raises(Exception):
        io.load_to_jdbc([named, bad], url, "T2", properties=how)
    assert read() == [("a", 1, "old"), ("b", None, "old"), ("c", None, "new")]
    assert io.load_to_jdbc(named.limit(1), url, "T2", mode="append", properties=how) == 1 and len(read()) == 4
    with io._connection(spark, url, how) as connection:
        left = connection.getMetaData().getTables(None, None, "T2_IN%", None)
        assert not left.next()
    with pytest.raises(ValueError):
        io.load_to_jdbc(spark.createDataFrame([("1",)], "nothing string"), url, "T2", properties=how)


def test_headers_of_all_files_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A;B\n1;2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿A;B\n3;4\n", encoding="utf-8")
    assert sorted(map(tuple, io.read_source_csv(spark, str(tmp_path)).collect())) == [("1", "2"), ("3", "4")]
    (tmp_path / "c.csv").write_text("B;A\n5;6\n", encoding="utf-8")
    with pytest.raises(ValueError, match="headers differ"):
        io.read_source_csv(spark, str(tmp_path))


def test_long_files_are_streamed(spark, tmp_path):
    for name, body in (("a", b"abc"), ("b", b"x" * 30_000_000), ("empty", b"")):
        (tmp_path / f"{name} 1.bin").write_bytes(body)
    got = {r["sha256"]: r["size"] for r in io.hash_files(spark, str(tmp_path), whole=1_000).collect()}
    assert got == {hashlib.sha256(b).hexdigest(): len(b) for b in (b"abc", b"x" * 30_000_000)}


def test_an_index_reads_the_categories_asked_for(spark, tables, tmp_path):
    features = FE.derive_search_columns(FE.build_features(tables)).withColumn("category", F.when(F.col("category") == "v", "a/b: 100% [é]").otherwise(F.col("category")))
    features = features.withColumn("search_categories", F.array_append("all_rubricas", F.col("category"))).cache()
    path = str(tmp_path / "i")
    CI.write_category_index(features, path)
    for wanted in (("r0", " r1 "), ("a/b: 100% [é]",), ("o", "r2", "none"), ("none",)):
        got = CI.indexed_features(spark, path, wanted)
        want = features.where(FI.category_filter(wanted)).select(*CI.COLUMNS, TI.matched_category(tuple(w.strip() for w in wanted)).alias("matched_category"))
        assert told(got) == told(want)
        assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= len(wanted)
    counts = CI.indexed_counts(spark, path)
    assert counts == {r["c"]: r["count"] for r in features.select(F.explode(F.array_distinct("search_categories")).alias("c")).groupBy("c").count().collect()}


def test_profiles_add_up(spark, tmp_path):
    rows = [(str(k % 7000), f"{k}.5" if k % 3 else "", "2024-01-01", None) for k in range(9_000)]
    whole = spark.createDataFrame(rows, "a string, b string, d string, n string")
    for k in range(3):
        whole.limit(9_000).where(F.col("a").cast("int") % 3 == k).write.parquet(f"{tmp_path}/f/part{k}")
    files = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/f")
    states = profile.profile_states(files, F.regexp_extract("_metadata.file_path", "part[0-9]", 0))
    merged, full = ({r["column"]: r.asDict() for r in df.collect()} for df in (profile.merge_states(states), profile.profile_columns(whole)))
    assert states.count() == 12 and merged == full  # counts of distinct values are past the cap, or few
    assert profile.merge_states(states).columns == profile.profile_columns(whole).columns
    found = states.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).collect()
    exact = {c: whole.where(f"{c} <> ''").select(c).distinct().count() for c in whole.columns}
    assert all(abs(r["n"] - exact[r["column"]]) <= 0.02 * exact[r["column"]] for r in found)
    other = spark.createDataFrame([("x", "1", "2024-01-01", "q")], whole.schema)
    changed = profile.refresh_states(states, spark.createDataFrame([("part1",)], "file string"), profile.profile_states(other, F.lit("part2")))
    left = whole.where("cast(a AS int) % 3 = 0").unionByName(other)
    got, want = ({r["column"]: r.asDict() for r in df.collect()} for df in (profile.merge_states(changed), profile.profile_columns(left)))
    for column, own in want.items():
        n = left.where(f"{column} <> ''").select(column).distinct().count()
        assert abs(got[column].pop("unique_count") - min(n, profile.MOST_UNIQUE)) <= 0.02 * n and own.pop("unique_count") is not None
        assert got[column] == own


def test_features_are_made_once_for_tile_points_and_for_metadata(spark, tmp_path):
    from occspark.operators import lookups, tile_store

    made = spark.sparkContext.accumulator(0)

    def seen(category):
        made.add(1)
        return category

    rows = "'Furto' AS category, 'x' AS rubrica_for_styling, array('Furto') AS all_rubricas, array('Furto') AS search_categories, date'2024-01-05' AS data_ocorrencia, 'a tarde' AS periodo_normalized, 3 AS hora_ocorrencia, 1 AS total_records"
    features = spark.sql(f"SELECT concat('DU', id) AS num_bo, 2024 AS ano_bo, 'DP' AS delegacia, 'h' AS location_hash, -23.5D AS latitude, -46.5D AS longitude, id * 10.0D AS x_3857, id * 10.0D AS y_3857, {rows} FROM range(50)").withColumn("category", F.udf(seen, "string")("category"))
    assert tile_store.write_tile_points(features, str(tmp_path / "points")) == 50 and made.value == 50
    row = lookups.tile_metadata(features).first()
    assert row["count"] == 50 and made.value == 100
