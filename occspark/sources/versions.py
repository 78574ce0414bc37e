"""Tables that are replaced in one step: new folders beside the old ones, then one list that names what is current.

A table is a folder with runs (what one write made, partitioned) and lists. A list names the
folder of every part of the table, and the latest list is the table: a part that is written
anew gets a new folder, parts that a write doesn't touch keep theirs, and readers see the old
list until the new one is whole and has its name. A write that fails leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LISTS = "_lists"
_NULL = "__HIVE_DEFAULT_PARTITION__"


def part_name(values: dict[str, object]) -> str:
    """The name of the part with these values, numbers or plain words."""
    return "/".join(f"{k}={_NULL if v is None else v}" for k, v in values.items())


@dataclass(frozen=True)
class Part:
    """One part of a table: its values (as in folder names), the folder that holds it, rows, and what the writer said of it."""

    name: str
    folder: str
    rows: int
    tags: tuple[str, ...] = ()

    def values(self) -> dict[str, str]:
        """The part's partition values as text."""
        return {k: unquote(v) for k, _, v in (x.partition("=") for x in self.name.split("/") if x)}


@dataclass(frozen=True)
class Listed:
    """A table's latest list: number (0 before the first), schema, parts by name, and options that its writers share."""

    number: int = 0
    schema: T.StructType = field(default_factory=T.StructType)
    parts: dict[str, Part] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    files, path = _at(spark, pattern)
    return [x.getPath().toString() for x in files.globStatus(path) or [] if x.isDirectory()]


def listed(spark: SparkSession, path: str) -> Listed:
    """The latest list of a table; without any, an empty one."""
    numbers = [int(name) for name in (f.rsplit("/", 1)[1] for f in _folders(spark, f"{path}/{_LISTS}/*")) if name.isdigit()]
    if not numbers:
        return Listed()
    told = json.loads(spark.read.text(f"{path}/{_LISTS}/{max(numbers)}").first()[0])
    parts = {p["name"]: Part(p["name"], p["folder"], p["rows"], tuple(p["tags"])) for p in told["parts"]}
    return Listed(max(numbers), T.StructType.fromJson(told["schema"]), parts, told["options"])


def publish(spark: SparkSession, path: str, before: Listed, schema: T.StructType, parts: Iterable[Part], options: dict[str, str]) -> None:
    """The next list after ``before``. It gets its name by one rename; if another writer has that name, nothing changes."""
    told = json.dumps({"schema": schema.jsonValue(), "parts": [asdict(p) for p in parts], "options": options})
    draft = f"{path}/{_LISTS}/draft-{uuid.uuid4().hex}"
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(draft)
    files, source = _at(spark, draft)
    _, target = _at(spark, f"{path}/{_LISTS}/{before.number + 1}")
    # a rename to a folder that is there would move into it
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
        raise RuntimeError(f"{path} was changed by another writer")


def write_parts(df: DataFrame, path: str, by: list[str], tags: Column | None = None, options: dict[str, str] | None = None) -> list[Part]:
    """Writes ``df`` as a new run with a folder for each value of ``by`` and reads back what each holds; nothing is current yet.

    tags: an array of texts in each row, united for a part. A run whose rows differ in number
    from what was sent is an error.
    """
    spark = df.sparkSession
    run = f"{path}/run={uuid.uuid4().hex}"
    sent = Observation()
    df.observe(sent, F.count(F.lit(1)).alias("rows")).write.options(**(options or {})).partitionBy(*by).parquet(run)
    kept = spark.read.schema(df.schema).option("basePath", run).parquet(run)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    rows = {unquote(r["folder"]): r["n"] for r in kept.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(rows.values()) != sent.get["rows"]:
        raise RuntimeError(f"{run} has {sum(rows.values())} rows of {sent.get['rows']}")
    seen = {} if tags is None else {unquote(r["folder"]): tuple(sorted(r["tags"])) for r in kept.select(folder.alias("folder"), F.explode(tags).alias("tag")).groupBy("folder").agg(F.collect_set("tag").alias("tags")).collect()}
    head = run.rsplit("/", 1)[1]
    return [Part(f.split(f"{head}", 1)[1].strip("/"), f, n, seen.get(f, ())) for f, n in sorted(rows.items())]


def read_parts(spark: SparkSession, path: str, table: Listed, parts: Iterable[Part] | None = None) -> DataFrame:
    """The rows of some parts of a table, or of all; only their folders are listed and read."""
    folders = [p.folder for p in (table.parts.values() if parts is None else parts)]
    if not folders:
        return spark.createDataFrame([], table.schema)
    with_run = T.StructType([*table.schema.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(with_run).option("basePath", path).parquet(*folders).select(*table.schema.names)


def replace_all(df: DataFrame, path: str, by: list[str] | None = None, **how) -> int:
    """``df`` instead of the whole table; gives the number of rows."""
    spark = df.sparkSession
    before = listed(spark, path)
    parts = write_parts(df, path, by or [], **how)
    publish(spark, path, before, df.schema, parts, before.options)
    return sum(p.rows for p in parts)


def replace_parts(df: DataFrame, path: str, by: list[str], emptied: Iterable[str] = (), **how) -> list[Part]:
    """``df`` instead of the parts that it has rows for; parts named in ``emptied`` go even without. Others keep their folders."""
    spark = df.sparkSession
    before = listed(spark, path)
    new = write_parts(df, path, by, **how)
    kept = {name: part for name, part in before.parts.items() if name not in set(emptied)}
    publish(spark, path, before, df.schema, (kept | {p.name: p for p in new}).values(), before.options)
    return new


def remove_unlisted(spark: SparkSession, path: str) -> int:
    """Deletes what the table's folder holds and the latest list doesn't name; for times without readers of older lists. Gives the number of folders and files."""
    table = listed(spark, path)
    depth = max((p.name.count("/") + 1 for p in table.parts.values() if p.name), default=0)
    have = {p.folder for p in table.parts.values()}
    files, _ = _at(spark, path)
    plain = [x.getPath().toString() for x in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*")) or []]
    gone = [f for f in plain if not f.rsplit("/", 1)[1].startswith(("_", "run="))]
    gone += [f for f in _folders(spark, f"{path}/run=*" + "/*" * depth) if f not in have]
    gone += [f for f in _folders(spark, f"{path}/run=*") if not any(h == f or h.startswith(f + "/") for h in have)]
    for found in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(found), True)
    return len(gone)
