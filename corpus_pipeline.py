"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage reads what the one before wrote. All but the last return the columns of documents.

In every stage a null text is an empty one (quality rejects it), rows are judged each by
itself however often an id occurs or whether it is null, whole texts are read, other columns
pass unchanged, and an empty table gives an empty one.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occspark.llm import decontaminate, neardup, packing, pii, quality
from occspark.llm.storage import stored


#: Rejected rows whose keys may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of one file have keys below this.
FILE_ROWS = 1 << 40


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column, whatever its case, is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that no two rows share and that each reading gives again (file, and place in it), and its column's name.

    What isn't a table of files by itself, or has a column where Spark keeps what it knows of
    files, is stored first.
    """
    names = docs.columns
    key, hidden = unused(names, "row_key"), unused(names, "_metadata")
    if hidden != "_metadata":
        docs = docs.select(*[F.col(f"`{c}`").alias(hidden if c.lower() == "_metadata" else c) for c in names])
    if hidden != "_metadata" or docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = stored(docs, "rows")
    path, place, file, known = (unused([*names, key, hidden], x) for x in ("row_path", "row_place", "row_file", "row_known"))
    files = sorted(r[0] for r in docs.select(F.col("_metadata.file_path").alias("path")).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{file} long, {known} string")
    own = [F.col(f"`{hidden if c.lower() == '_metadata' else c}`").alias(c) for c in names]
    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    return placed.join(F.broadcast(numbers), F.col(path) == F.col(known)).select(*own, (F.col(file) * FILE_ROWS + F.col(place)).alias(key)), key


def by_row(rows: DataFrame, key: str) -> DataFrame:
    """Keyed rows with the key as doc_id, for operators that tell rows by doc_id."""
    return rows.withColumn("doc_id", F.col(key)).drop(key)


def without(rows: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """Keyed ``rows`` with their own columns, less those whose key is in ``rejected`` (one column)."""
    name = unused(rows.columns, "rejected_row")
    keys = stored(rejected.toDF(name), "rejected")
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return rows.join(keys, F.col(key) == F.col(name), "left_anti").drop(key)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the fertility rules keep."""
    rows, key = keyed(docs)
    return without(rows, key, quality.judged(by_row(rows, key)).where("not kept").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at 80 % of five-word shingles: that of least doc_id, null after all others, then the first row."""
    rows, key = keyed(docs)
    found = stored(neardup.near_duplicates(by_row(rows, key), 5, Fraction(4, 5)).select(F.col("doc_id").alias("member"), F.col("component_id").alias("component")), "found")
    moved = found.where("member <> component")
    members = moved.unionByName(moved.select(F.col("component").alias("member"), "component").distinct())
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"))
    members = stored(members.join(ids, F.col("member") == F.col("row")).select("member", "component", "id"), "members")
    # rows are told apart by their own keys: a large group is one key of the aggregation alone
    kept = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "member"))["member"].alias("kept_row"))
    return without(rows, key, members.join(kept.select("kept_row"), F.col("member") == F.col("kept_row"), "left_anti").select("member"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redacted(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Tokens, message passing and learnt bands aren't for SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
