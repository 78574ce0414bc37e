"""Files and tables in and out (O-1.*)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_column_name, normalize_lookup_key, source_text
from . import versions
from .schema import map_columns
from .scratch import stored
from .split_csv import split_rows

# The columns of a coroner export, and of its table.
CORONER_INPUT = ("DataEntradaIML", "AnoBO", "NumeroBO", "NomeDelegaciaOrigem", "NumeroLaudo", "AnoLaudo", "IdadeVitima", "TipoIdade", "Conclusao", "DeclaracaoObito", "CausaMortis")
CORONER_OUTPUT = ("DATA_ENTRADA_IML", "ANO_BO", "NUM_BO", "DELEGACIA_REGISTRO", "NUMERO_LAUDO", "ANO_LAUDO", "IDADE_VITIMA", "TIPO_IDADE", "CONCLUSAO", "DECLARACAO_OBITO", "CAUSA_MORTIS")
# Parts of the names of sheets that hold no data.
DOCUMENT_SHEETS = ("METODOLOGIA", "DICIONARIO", "CAMPOS", "TABELA")


_CSV = {"sep": ";", "quote": '"', "escape": '"', "multiLine": True, "columnPruning": False}


def read_source_csv(spark: SparkSession, path: str, strict: bool = False, split: bool = False) -> DataFrame:
    """O-1.1: ``;`` and a header, all text. Ragged rows are dropped, or fail if ``strict``.

    Cells and headers may hold separators, quotes and line breaks within quotes, so a file is
    read by one task (files are at most 1.5 GB), or if ``split`` by one for each of its splits,
    for the price of a shuffle; then lines must end with \\n or \\r\\n. The header is applied by position, as Spark
    renames repeated ones; repeats keep their names and are for drop_identical_duplicate_columns.
    Of a path with several files each must have the first one's header, else it is an error.
    """
    files = spark.read.text(path).inputFiles()
    headers = {_header(spark, f) for f in files} if len(files) > 1 else {_header(spark, path)}
    if len(headers) > 1:
        raise ValueError(f"headers differ: {sorted(map(list, headers))}")
    names = list(next(iter(headers), ()))
    if split and names:
        return split_rows(spark, path, names, _CSV, strict).toDF(*names)
    schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(names))])
    # with column pruning, ragged rows would still count
    rows = spark.read.options(**_CSV).csv(path, header=True, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED", enforceSchema=True)
    return rows.toDF(*names) if names else rows


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The names in a file's first row, from its first line on; an empty file has none."""
    # one row is asked for, so the reader stops after it
    header = spark.read.options(**_CSV).csv(file, header=False).limit(1).collect()
    return tuple((x or "").lstrip("\ufeff").strip() for x in header[0]) if header else ()


def write_source_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """O-1.2: ``;`` and a header; all cells quoted, or those that need it. Blanks around a cell stay."""
    df.write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"', quoteAll=quote_all, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_parquet_text(spark: SparkSession, path: str) -> DataFrame:
    """O-1.3: every column as text, NULL as ''."""
    df = spark.read.parquet(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def text_columns(df: DataFrame) -> DataFrame:
    """Every column as trimmed text, blank as NULL."""
    return df.select(*[source_text(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def write_parquet_text(df: DataFrame, path: str) -> None:
    """O-1.4: :func:`text_columns`, Snappy."""
    text_columns(df).write.mode("overwrite").option("compression", "snappy").parquet(path)


def merge_tables(tables: list[DataFrame]) -> DataFrame:
    """O-1.5: tables of one and the same header, one after another; any other header is an error, the first's too."""
    if not tables:
        raise ValueError("nothing to merge")
    for t in tables[1:]:
        if t.columns != tables[0].columns:
            raise ValueError(f"headers differ: {tables[0].columns} and {t.columns}")
    return reduce(DataFrame.unionAll, tables)


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """O-1.6: the first rows."""
    return df.limit(n)


def normalized_file_name(name: Column) -> Column:
    """A file name for pattern tests: no marks, upper case, other characters as one ``_``."""
    return F.translate(normalize_lookup_key(name), " ", "_")


def select_files_for_category(files: DataFrame, patterns: list[str]) -> DataFrame:
    """O-1.7: files (column name) that hold any pattern; without patterns all. No match is an error."""
    if not patterns:
        return files
    wanted = [F.contains(normalized_file_name(F.col("name")), normalized_file_name(F.lit(p))) for p in patterns]
    found = files.where(reduce(Column.__or__, wanted))
    if found.isEmpty():
        raise ValueError(f"no file matches {patterns}")
    return found


def union_source_tables(tables: dict[str, DataFrame], prefix: str) -> DataFrame:
    """O-1.8: the tables whose names start with ``prefix``, each row with its source_table; missing columns are NULL."""
    own = [df.withColumn("source_table", F.lit(name)) for name, df in sorted(tables.items()) if name.startswith(prefix)]
    if not own:
        raise ValueError(f"no table starts with {prefix}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def match_column(name: str, among: list[str]) -> str | None:
    """The column that a name means: exactly, normalized, or without case."""
    if name in among:
        return name
    for same in (normalize_column_name, str.lower):
        for other in among:
            if same(other) == same(name):
                return other
    return None


def evolve_table(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """O-1.9: all rows; columns that the table doesn't have yet are added to it as text."""
    renamed = [F.col(f"`{c}`").cast("string").alias(match_column(c, existing.columns) or c) for c in incoming.columns]
    kept = existing.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in existing.columns])
    return kept.unionByName(incoming.select(*renamed), allowMissingColumns=True)


def with_stable_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """A gapless ``id`` from 1 in the order of some columns.

    Rows are dealt by ranges of the order and stored; the counts of the ranges, one row each,
    give each its start, and each range numbers its own rows.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), F.col("_range") == F.col("_of")).select(*df.columns, (F.col("_start") + F.col("_own")).cast("long").alias("id"))


def replace_table(tables: list[DataFrame], path: str) -> int:
    """O-1.10: the union of all files instead of what was there; gives the number of rows.

    The new rows are written beside the old ones and counted; one rename makes them current,
    then the old ones go. If anything fails before, the table is as it was.
    """
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    rows = versions.replace_all(whole, path)
    versions.remove_unlisted(whole.sparkSession, path)
    return rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that replace_table or replace_month keeps."""
    return versions.read_parts(spark, path, versions.listed(spark, path))


_MONTH = ["ANO_REFERENCIA", "MES_REFERENCIA"]


def replace_month(df: DataFrame, path: str) -> None:
    """O-1.11: rows of the months in ``df`` instead of those months' rows; other months stay.

    All months change together, as in replace_table. Rows are rebalanced by month, so a large
    month is written by several tasks and small ones share one.
    """
    versions.replace_parts(df.hint("rebalance", *_MONTH), path, _MONTH)
    versions.remove_unlisted(df.sparkSession, path)


def coroner_rows(raw: DataFrame, year: int, month: int) -> DataFrame:
    """The table's rows from an export's 11 columns: trimmed, blank rows dropped, reference month and keys added."""
    if tuple(raw.columns) != CORONER_INPUT:
        raise ValueError(f"unexpected columns {raw.columns}")
    rows = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(o) for c, o in zip(CORONER_INPUT, CORONER_OUTPUT, strict=True)])
    rows = rows.where(F.concat(*CORONER_OUTPUT) != "")
    return rows.withColumns({"ANO_REFERENCIA": F.lit(str(year)), "MES_REFERENCIA": F.lit(f"{month:02d}"), "NUM_BO_NORMALIZED": normalize_lookup_key("NUM_BO"), "DELEGACIA_REGISTRO_NORMALIZED": normalize_lookup_key("DELEGACIA_REGISTRO")})


def read_coroner_export(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """O-1.12: a UTF-16 tab-separated export; an entry date of another month is an error."""
    raw = spark.read.csv(path, sep="\t", encoding="UTF-16LE", header=True, multiLine=True)
    rows = coroner_rows(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]), year, month)
    wrong = rows.where((F.col("DATA_ENTRADA_IML") != "") & ~F.contains("DATA_ENTRADA_IML", F.lit(f"/{month:02d}/{year}")))
    if not wrong.isEmpty():
        raise ValueError(f"entry dates outside {month:02d}/{year}")
    return rows


#: Files up to so many bytes are hashed as one value; longer ones are streamed.
WHOLE_FILE = 256 << 20
_BLOCK = 8 << 20


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = []
        for path in batch.column(0).to_pylist():
            system, name = pa.fs.FileSystem.from_uri(quote(path, safe="/:"))
            digest = hashlib.sha256()
            with system.open_input_stream(name) as file:
                while block := file.read(_BLOCK):
                    digest.update(block)
            told.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), batch.column(1)], names=["path", "sha256", "size"])


def hash_files(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """O-1.13: (path, sha256, size). Spark lists no file without bytes, so such a file has no row.

    Files of more than ``whole`` bytes are opened by the tasks and read block by block, so
    their size doesn't matter; that needs a file system that Arrow knows (file, hdfs, s3, gs).
    """
    files = spark.read.format("binaryFile").load(path)
    short = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    # one file a task, about: no row says how long its work is but its size
    long = files.where(F.col("length") > whole).select("path", F.col("length").alias("size"))
    if long.isEmpty():
        return short
    spread = long.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return short.unionByName(spread.mapInArrow(_streamed_digests, "path string, sha256 string, size long"))


def load_to_jdbc(tables: DataFrame | list[DataFrame], url: str, table: str, mode: str = "overwrite", properties: dict[str, str] | None = None) -> int:
    """O-1.14: the text columns of one or several files, '' as NULL, into a database table; gives the number of rows.

    Each file's columns are mapped to the table's by name (map_columns) and take their types;
    what the table doesn't have is left out, what a file doesn't have takes the table's
    default. Tasks write each file to a table of its own; then one transaction empties the
    table (``overwrite``) and takes the rows over, so that it has all files or none. A table
    that doesn't exist is made like the first file; one that does keeps its definition.
    """
    files = [tables] if isinstance(tables, DataFrame) else list(tables)
    spark, how = files[0].sparkSession, properties or {}
    texts = [text_columns(df) for df in files]
    with _connection(spark, url, how) as connection:
        about = connection.getMetaData()
        mark = (about.getIdentifierQuoteString() or "").strip()
        quoted = lambda name: f"{mark}{name}{mark}"
        if not about.getTables(None, None, table, None).next():
            texts[0].limit(0).write.jdbc(url, table, mode="append", properties=how)
    kinds = {f.name: f.dataType for f in spark.read.jdbc(url, table, properties=how).schema}
    staged, rows = [], 0
    try:
        for k, df in enumerate(texts):
            mapped = map_columns(df.columns, list(kinds))
            name = f"{table}_IN_{k}_{uuid.uuid4().hex[:8]}".upper()
            staged.append((name, list(mapped.values())))
            df.select(*[F.col(f"`{c}`").cast(kinds[to]).alias(to) for c, to in mapped.items()]).write.jdbc(url, name, mode="append", properties=how)
        with _connection(spark, url, how) as connection:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            try:
                if mode == "overwrite":
                    statement.executeUpdate(f"DELETE FROM {table}")
                for name, columns in staged:
                    listed = ", ".join(map(quoted, columns))
                    rows += statement.executeUpdate(f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {name}")
                connection.commit()
            except Exception:
                connection.rollback()
                raise
    finally:
        with _connection(spark, url, how) as connection:
            for name, _ in staged:
                if connection.getMetaData().getTables(None, None, name, None).next():
                    connection.createStatement().executeUpdate(f"DROP TABLE {name}")
    return rows


@contextmanager
def _connection(spark: SparkSession, url: str, properties: dict[str, str]) -> Iterator:
    if "driver" in properties:
        spark._jvm.java.lang.Class.forName(properties["driver"])
    own = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        own.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        yield connection
    finally:
        connection.close()


def escape_formula(c: Column) -> Column:
    """O-1.15: a quote before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def is_data_sheet(name: Column) -> Column:
    """O-1.16: not a sheet of methods, dictionaries, fields or tables."""
    return ~normalized_file_name(name).rlike("|".join(DOCUMENT_SHEETS))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """O-1.17: cells equal to NULL become blank, rows without any text go."""
    blanked = df.select(*[F.when(F.upper(F.trim(F.col(f"`{c}`"))) == "NULL", "").otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return blanked.where(F.coalesce(*[source_text(F.col(f"`{c}`")) for c in df.columns]).isNotNull())
