"""The test tables in the shape of occurrence tables.

One SELECT each, in SQL that Spark and DuckDB read alike; integer arithmetic alone, so both
give the same text. Every table grows with the events (or orders) it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE

TABLES = ("celulares_2024", "veiculos_2024", "objetos_2024", "dados_criminais_2024", "produtividade_entorpecentes_2024")

#: Tables of the other record types, each from a third of the rows.
OTHER_TABLES = ("produtividade_armas_2024", "produtividade_veiculos_recuperados_2024", "produtividade_presos_2024")

#: Raw rows of the five tables (src is the place in TABLES): ten events share a report, text is noisy on purpose.
RAW_SQL = """
SELECT event_id + 1 AS id, event_id % 5 AS src, 'DU' || lpad(cast(g AS string), 6, '0') AS NUM_BO, '2024' AS ANO_BO,
  CASE g % 7 WHEN 0 THEN '  ' WHEN 1 THEN '01º D.P. - Mauá' ELSE 'DP ' || cast(g % 7 AS string) END AS NOME_DELEGACIA,
  CASE WHEN g % 51 = 1 THEN '' WHEN g % 50 = 0 THEN '-10,5' ELSE '-23' || sep || cast(100000 + (g * 137) % 800000 + event_id % 3 AS string) END AS LATITUDE,
  CASE WHEN g % 53 = 2 THEN 'sem' ELSE '-46' || sep || cast(100000 + (g * 311) % 800000 AS string) END AS LONGITUDE,
  CASE event_id % 3 WHEN 0 THEN '2024-01-' || dd WHEN 1 THEN dd || '/01/2024' ELSE cast(45291 + d AS string) || '.5' END AS DATA_OCORRENCIA_BO,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE lpad(cast(h AS string), 2, '0') || ':' || lpad(cast(mi AS string), 2, '0') END AS HORA_OCORRENCIA,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN h < 6 THEN 'De madrugada' WHEN h < 12 THEN '  PELA   MANHÃ ' WHEN h < 18 THEN ' À TARDE' WHEN h < 23 THEN 'À NOITE' ELSE 'turno extra' END AS DESCR_PERIODO,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE 'Furto - ' || event_type END AS RUBRICA,
  'Natureza ' || event_type AS NATUREZA_APURADA, 'Conduta ' || cast(g % 3 AS string) AS DESCR_CONDUTA,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Tipo ' || cast(event_id % 30 AS string) END AS DESCR_TIPO_OBJETO, 'Sub ' || cast(event_id % 4 AS string) AS DESCR_SUBTIPO_OBJETO,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE 'Marca ' || cast(event_id % 8 AS string) END AS MARCA_OBJETO, CASE WHEN event_id % 10 = 3 THEN 'x' ELSE cast(event_id % 4 AS string) END AS QUANTIDADE_OBJETO,
  CASE event_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' ELSE '' END AS FLAG_BLOQUEIO,
  'Carro ' || cast(event_id % 3 AS string) AS DESCR_TIPO_VEICULO, CASE WHEN event_id % 8 = 1 THEN '' ELSE 'Fab ' || cast(event_id % 6 AS string) END AS DESCR_MARCA_VEICULO, cast(2000 + event_id % 20 AS string) AS ANO_MODELO,
  CASE WHEN event_id % 6 = 4 THEN '' ELSE 'Droga ' || cast(event_id % 8 AS string) END AS DESCR_TOXICO, cast(event_id % 300 AS string) || ',5' AS QTDE_GRAMAS_ARRED,
  'Cidade ' || cast(g % 9 AS string) AS CIDADE, CASE WHEN g % 4 = 0 THEN '' ELSE 'Via ' || cast(g % 15 AS string) END AS DESCR_TIPOLOCAL, 'Circ ' || cast(g % 20 AS string) AS NOME_DELEGACIA_CIRC,
  event_id % 3 AS kind, CASE WHEN event_id % 4 = 1 THEN '' ELSE 'Arma ' || cast(event_id % 5 AS string) END AS DESC_ARMA_FOGO, '.' || cast(30 + event_id % 9 AS string) AS CALIBRE, ' Forja ' || cast(event_id % 2 AS string) AS ARMA_NOME_MARCA,
  'AAA' || lpad(cast(event_id % 1000 AS string), 4, '0') AS PLACA_VEICULO, CASE event_id % 5 WHEN 0 THEN '+31' WHEN 1 THEN '2e1' WHEN 2 THEN '47,9' WHEN 3 THEN 'x' ELSE ' 18 ' END AS IDADE_PESSOA,
  CASE WHEN event_id % 4 = 2 THEN ' ' ELSE 'Cor ' || cast(event_id % 3 AS string) END AS COR_CUTIS, 'Curtis' AS COR_CURTIS, CASE event_id % 4 WHEN 0 THEN ' sim' WHEN 1 THEN 'N' WHEN 2 THEN 'talvez' ELSE '' END AS FLAG_FLAGRANTE,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '2024-01-' || dd || ' 10:00:00' ELSE dd || '-01-2024' END AS DATA_REGISTRO, '2024-02-' || dd || 'T08:00' AS DATAHORA_REGISTRO_BO
FROM (SELECT event_id, event_type, cast(floor(event_id / 10) AS bigint) AS g, hour(ts) AS h, minute(ts) AS mi, day(ts) AS d, lpad(cast(day(ts) AS string), 2, '0') AS dd, CASE event_id % 2 WHEN 0 THEN '.' ELSE ',' END AS sep FROM events) AS e
"""

#: Coroner rows: every third report, keys written another way.
CORONER_SQL = """
SELECT event_id + 1 AS id, 'registro_obitos_iml_2024' AS source_table, ' du' || lpad(cast(cast(floor(event_id / 10) AS bigint) AS string), 6, '0') || ' ' AS NUM_BO, '2024' AS ANO_BO,
  CASE cast(floor(event_id / 10) AS bigint) % 7 WHEN 0 THEN '' WHEN 1 THEN '01º d.p. mauá' ELSE 'dp-' || cast(cast(floor(event_id / 10) AS bigint) % 7 AS string) END AS DELEGACIA_REGISTRO,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN lpad(cast(1 + event_id % 28 AS string), 2, '0') || '/01/2024 09:05:00' ELSE lpad(cast(1 + event_id % 28 AS string), 2, '0') || '/02/2024' END AS DATA_ENTRADA_IML,
  'Causa ' || cast(event_id % 5 AS string) AS CAUSA_MORTIS
FROM events WHERE event_id % 6 = 2
"""

#: Cell values as they occur in source files, one for each event.
NOISY_SQL = """
SELECT event_id AS id, CASE event_id % 40 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN 'nullnull' WHEN 3 THEN 'NÃO INFORMADO' WHEN 4 THEN ' nao  informado ' WHEN 5 THEN '#####'
  WHEN 6 THEN '12345-678' WHEN 7 THEN '123-456-' || cast(n AS string) WHEN 8 THEN '-' || cast(n AS string) WHEN 9 THEN cast(n AS string) || ',45' WHEN 10 THEN '1.234,' || lpad(cast(n % 100 AS string), 2, '0')
  WHEN 11 THEN '-22,.8' WHEN 12 THEN '12..34' WHEN 13 THEN cast(n AS string) || '.' WHEN 14 THEN '14:30' WHEN 15 THEN '9:05' WHEN 16 THEN '14h' || lpad(cast(n % 70 AS string), 2, '0') WHEN 17 THEN '1430'
  WHEN 18 THEN '230' WHEN 19 THEN '0.25' WHEN 20 THEN lpad(cast(1 + n % 31 AS string), 2, '0') || '/02/2024' WHEN 21 THEN lpad(cast(1 + n % 28 AS string), 2, '0') || '-01-20' || lpad(cast(10 + n % 15 AS string), 2, '0') WHEN 22 THEN '2024-01-15'
  WHEN 23 THEN cast(41270 + n % 10 AS string) WHEN 24 THEN '45292.5' WHEN 25 THEN '2024-01-15 10:30:00' WHEN 26 THEN 'DE MADRUGADA' WHEN 27 THEN 'S' WHEN 28 THEN 'sim' WHEN 29 THEN ' N ' WHEN 30 THEN '-23,5505'
  WHEN 31 THEN '01/15/2024' WHEN 32 THEN '31/02/2024' WHEN 33 THEN '25:00' WHEN 34 THEN '23.30' WHEN 35 THEN '1e5' WHEN 36 THEN 'Avenida São João' WHEN 37 THEN '  PELA   MANHÃ ' WHEN 38 THEN '23:10:59' ELSE '12.5' END AS v
FROM (SELECT event_id, (event_id * 7919) % 977 AS n FROM events) AS e
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_to(spark: SparkSession) -> int:
    """Partitions that costly rows are dealt to: several for each core, so that no core waits for the last."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 2 * spark.sparkContext.defaultParallelism))


def _select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # a file is read by as many tasks as it has row groups, and each row costs much: the few columns are dealt anew first,
    # to a given number of tasks, as Spark would join the small partitions into about one for each core
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "ts").repartition(dealt_to(spark), "event_id")
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=events)


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five raw tables by name."""
    whole = _select(spark, sf_dir, RAW_SQL)
    return {name: whole.where(F.col("src") == k).drop("src") for k, name in enumerate(TABLES)}


def other_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of the other record types by name."""
    whole = _select(spark, sf_dir, RAW_SQL)
    return {name: whole.where(F.col("kind") == k).drop("src") for k, name in enumerate(OTHER_TABLES)}


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v)."""
    return _select(spark, sf_dir, NOISY_SQL)


def coroner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coroner rows."""
    return _select(spark, sf_dir, CORONER_SQL)


def search_features(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Merged features of the tables with their search columns, and of their structs some fields alone if they are named."""
    raw = raw_tables(spark, sf_dir)
    return FE.derive_search_columns(FE.build_features({t: raw[t] for t in tables}, None if fields is None else (*FE.SEARCHED, *fields)))
