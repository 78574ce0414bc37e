"""Prefix tries of conversations from vertical bitmaps.

A node is a sequence of turns that conversations start with. Conversations are dealt to
shards by how they start; groups with one start that are too large for a shard are dealt to
several. A shard indexes (position, turn) to a bitset of its conversations and walks depth
first: the children of a node are the intersections of its bitset with the postings of the
next position, a popcount gives their members, the lowest bit the smallest one, and the bits
that have no further turn are the list of ends. Nodes of groups in several shards are added
up by a print of their path.

A path's print is the sum of hashes of its (position, turn) pairs, so it is a running sum
that any number of tasks can share: a conversation with very many turns is cut into segments,
which are walked like conversations that start at the print before them.

What a subtree adds up is a sum over members: each node belongs to its smallest member, which
then owns the rest of its own path too; a node's subtree is what its members own, less what
its own member owns above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored

#: Turns of a segment.
SEGMENT = 1_024
#: Turns and segments of a shard, about; a group of conversations with one start that has more turns is dealt to several.
SHARD_TURNS = 16_384
SHARD_UNITS = 512
#: Nodes with more children are joined with them apart, so that no task gets all.
MANY_CHILDREN = 10_000
#: Rows of the tables of large groups and nodes that may be broadcast (some 60 bytes each).
BROADCAST_ROWS = 200_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_LANES = ("l0", "l1", "l2", "l3")


def _root() -> Column:
    return F.unhex(F.lit("0" * 32))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def turn_key() -> Column:
    """16 bytes for a turn's (role, text); null is empty."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, total, part, key, words): each turn with its place from 1 in its conversation and the number of turns there.

    Turns follow ``turn``, null first, ties the digest of role and text. Rows are dealt by
    ranges of that order, so a conversation of any size is ranked by many tasks: part is the
    range, and a range's start in a conversation is a sum over the ranges before.
    """
    spark = conversations.sparkSession
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    thin = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_key().alias("key"), words.alias("words"), F.monotonically_increasing_id().alias("at"))
    order = ["turn", "key", "at"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(stored(thin, "turns").repartitionByRange(ranges, "conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    whole = Window.partitionBy("conv_id").orderBy("part")
    sizes = dealt.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), (F.sum("n").over(whole) - F.col("n")).alias("_start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    own = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    ranked = dealt.withColumn("own", own).join(starts, (F.col("part") == F.col("_part")) & (F.col("conv_id") == F.col("_conv")))
    return ranked.select("conv_id", (F.col("_start") + F.col("own")).alias("pos"), "total", "part", "key", "words")


def replayed(turns: DataFrame, take: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on others: the first ``take`` turns of conversation ``base``, then the own ones after the first ``take``.

    turns: :func:`ordered_turns`; take (at most 3) and base are expressions of conv_id. Gives
    the turns (conv_id, depth, key, words) and (conv_id, size) of all conversations.
    """
    turns = stored(turns, "ordered")
    each = turns.where("pos = 1").select("conv_id", "total", take.alias("h"), base.alias("base"))
    lengths = each.select(F.col("conv_id").alias("_base"), F.col("total").alias("_total"))
    convs = stored(each.join(lengths, F.col("base") == F.col("_base"), "left").select("conv_id", "total", "h", "base", F.least("h", F.coalesce("_total", F.lit(0))).alias("m")), "convs")
    # a conversation in many parts is met in each of them
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "part").join(convs.select("conv_id", "h", "m"), "conv_id")
    own = turns.join(parts, ["conv_id", "part"]).where("pos > h").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "key", "words")
    first = turns.where("pos <= 3").select(F.col("conv_id").alias("_base"), "pos", "key", "words")
    taken = convs.join(first, (F.col("base") == F.col("_base")) & (F.col("pos") <= F.col("m"))).select("conv_id", F.col("pos").alias("depth"), "key", "words")
    return own.unionByName(taken), convs.select("conv_id", (F.col("m") + F.greatest(F.lit(0), F.col("total") - F.col("h"))).alias("size"))


def _segment(size: int) -> Column:
    return F.floor(F.greatest(F.lit(0), F.col("depth") - 1) / size).cast("long")


def _running(rows: DataFrame, values: tuple[str, ...], size: int, back: bool = False) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with the segment, and each value as its sum from the conversation's start to here (or from here to its end).

    Segments are summed by themselves; what comes before a segment is a sum over segments.
    more: whether the conversation has rows in a later segment.
    """
    rows = rows.withColumn("seg", _segment(size))
    totals = rows.groupBy("conv_id", "seg").agg(*[F.sum(v).alias(v) for v in values])
    along = Window.partitionBy("conv_id").orderBy(F.desc("seg") if back else F.asc("seg"))
    before = totals.select(F.col("conv_id").alias("_conv"), F.col("seg").alias("_seg"), *[(F.sum(v).over(along) - F.col(v)).alias(f"_{v}") for v in values], F.lead("seg").over(Window.partitionBy("conv_id").orderBy("seg")).isNotNull().alias("more"))
    own = Window.partitionBy("conv_id", "seg").orderBy(F.desc("depth") if back else F.asc("depth"))
    summed = rows.withColumns({v: F.sum(v).over(own) for v in values})
    joined = summed.join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("seg") == F.col("_seg")))
    return joined.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_conv", "_seg", *[f"_{v}" for v in values])


def _print(lanes: list[Column]) -> Column:
    """16 bytes from four sums."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for c in lanes]))


def units(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, start, first, more, turns): segments with the print before them, their first key, and turns (depth, key, words, print)."""
    mixed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("key")).cast("binary"))
    lanes = {n: F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("long") for k, n in enumerate(_LANES)}
    hashed = turns.select("conv_id", "depth", "key", "words", *[c.alias(n) for n, c in lanes.items()], *[c.alias(f"own_{n}") for n, c in lanes.items()])
    summed = _running(hashed, _LANES, size)
    each = F.struct("depth", "key", "words", _print([F.col(n) for n in _LANES]).alias("print"), _print([F.col(n) - F.col(f"own_{n}") for n in _LANES]).alias("before"))
    grouped = summed.groupBy("conv_id", "seg", "more").agg(F.sort_array(F.collect_list(each)).alias("turns"))
    thin = F.transform("turns", lambda t: F.struct(t["depth"].alias("depth"), t["key"].alias("key"), t["words"].alias("words"), t["print"].alias("print")))
    return grouped.select("conv_id", "seg", F.col("turns")[0]["before"].alias("start"), F.col("turns")[0]["key"].alias("first"), "more", thin.alias("turns"))


_NODES = "print binary, parent binary, depth long, conv_id long, n_convs long, words long, whole boolean, ends_sha256 string, ends array<long>"


def ends_digest(ids: list[int]) -> str:
    """SHA-256 of ascending ids, comma-joined."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def walk(shard: list[dict]) -> Iterator[tuple]:
    """The nodes (as _NODES) below the starts of a shard's units, depth first.

    Nodes of units that no other shard shares (whole) have their digest of ends, others the ends.
    """
    shard = sorted(shard, key=lambda u: u["conv_id"])  # the lowest bit is the smallest conversation
    index: dict[tuple[int, bytes], int] = {}
    last: dict[int, int] = {}  # units by the depth of their last turn
    starts: dict[tuple[int, bytes], int] = {}
    more = 0
    for k, unit in enumerate(shard):
        bit = 1 << k
        for turn in unit["turns"]:
            place = (turn["depth"], turn["key"])
            index[place] = index.get(place, 0) | bit
        depth = unit["turns"][-1]["depth"]
        last[depth] = last.get(depth, 0) | bit
        start = (unit["turns"][0]["depth"] - 1, unit["start"])
        starts[start] = starts.get(start, 0) | bit
        more |= bit if unit["more"] else 0
    stack = [(members, depth, start) for (depth, start), members in starts.items()]
    while stack:
        members, depth, parent = stack.pop()
        left = members & ~last.get(depth, 0)
        while left:
            unit = shard[(left & -left).bit_length() - 1]
            turn = unit["turns"][depth + 1 - unit["turns"][0]["depth"]]
            child = members & index[depth + 1, turn["key"]]
            left &= ~child
            ends = [shard[k]["conv_id"] for k in _bits(child & last.get(depth + 1, 0) & ~more)]
            whole = unit["parts"] == 1
            yield turn["print"], parent, depth + 1, unit["conv_id"], child.bit_count(), turn["words"], whole, ends_digest(ends) if whole else None, None if whole else ends
            stack.append((child, depth + 1, turn["print"]))


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("print", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("whole", pa.bool_()), ("ends_sha256", pa.string()), ("ends", pa.list_(pa.int64()))])

    def sent(shard: list[dict]) -> pa.RecordBatch:
        nodes = list(zip(*walk(shard), strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(nodes, schema, strict=True)], schema=schema)

    shard: list[dict] = []
    group, turns = None, 0
    for batch in batches:
        for unit in batch.to_pylist():
            own = unit["seg"], unit["start"], unit["first"], unit["part"]
            if own != group and (turns >= SHARD_TURNS or len(shard) >= SHARD_UNITS):
                yield sent(shard)
                shard, turns = [], 0
            group = own
            shard.append(unit)
            turns += len(unit["turns"])
    yield sent(shard)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, ends_sha256) from rows (print, conv_id) sorted by both; a digest grows row by row."""
    found: list[tuple[bytes, str]] = []
    own, digest = None, None
    for batch in batches:
        for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node == own:
                digest.update(b",%d" % conv_id)
                continue
            if own is not None:
                found.append((own, digest.hexdigest()))
            own, digest = node, hashlib.sha256(b"%d" % conv_id)
        yield _digests(found)
        found = []
    yield _digests(found if own is None else [*found, (own, digest.hexdigest())])


def _digests(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["print", "ends_sha256"])


def trie_nodes(cut: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(print, parent, depth, conv_id, n_convs, words, ends_sha256) of every node, the root among them.

    cut: :func:`units`; convs: (conv_id, size) of all conversations, also of those without turns.
    """
    start = ["seg", "start", "first"]
    groups = cut.groupBy(*start).agg(F.sum(F.size("turns")).alias("t")).where(F.col("t") > shard_turns)
    large = stored(groups.select(*start, F.ceil(F.col("t") / shard_turns).cast("int").alias("parts")), "groups")
    dealt = cut.join(_small(large), start, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("conv_id"), F.col("parts")).cast("int"))
    spread = dealt.repartition(*start, "part").sortWithinPartitions(*start, "part", "conv_id")
    walked = stored(spread.mapInArrow(_walk_batches, _NODES), "walked")
    shared = walked.where("not whole")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(_root().alias("print"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    met = shared.groupBy("print").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"))
    ends = shared.select("print", F.explode("ends").alias("conv_id")).unionByName(convs.where("size = 0").select(_root().alias("print"), "conv_id"))
    digests = ends.repartition("print").sortWithinPartitions("print", "conv_id").mapInArrow(_digest_batches, "_print binary, ends_sha256 string")
    met = met.unionByName(root).join(digests, F.col("print") == F.col("_print"), "left").drop("_print").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return walked.where("whole").select(*met.columns).unionByName(met)


def _with_parents(nodes: DataFrame, many: int) -> DataFrame:
    """Nodes with the conv_id of their parent. Nodes with very many children meet them by a broadcast where that is small."""
    owners = nodes.select(F.col("print").alias("_print"), F.col("conv_id").alias("_conv"), "n_children")
    hot = _small(stored(owners.where(F.col("n_children") > many).select(F.col("_print").alias("_hot"), F.col("_conv").alias("_hot_conv")), "hot"))
    marked = nodes.join(hot, F.col("parent") == F.col("_hot"), "left")
    rest = owners.where((F.col("n_children") > 0) & (F.col("n_children") <= many)).drop("n_children")
    cold = F.when(F.col("_hot").isNull(), F.col("parent"))
    # children of hot nodes have no match here; a print of their own spreads them
    key = F.coalesce(cold, F.col("print"))
    joined = marked.join(rest, (key == F.col("_print")) & F.col("_hot").isNull(), "left")
    return joined.withColumn("parent_conv_id", F.coalesce("_hot_conv", F.when(F.col("parent").isNotNull(), F.col("_conv")))).drop("_hot", "_hot_conv", "_print", "_conv")


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS, many: int = MANY_CHILDREN) -> DataFrame:
    """The trie of conversations given as turns (conv_id, depth, key, words) and (conv_id, size): one row a node.

    conv_id: smallest member; depth; parent_conv_id (null at the root); n_convs; n_children;
    n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, words of a
    node's last turn times members less one; ends_sha256: of the ids that end at the node.
    Conversations without turns are members of the root alone; equal conversations share all
    nodes; any number of turns is cut into segments; no conversations give no rows.
    """
    cut = stored(units(turns, segment), "units")
    nodes = stored(trie_nodes(cut, convs, shard_turns), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("_parent")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("print") == F.col("_parent"), "left").drop("_parent").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("below", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    owned = nodes.groupBy("conv_id").agg(F.sum("below").alias("tokens"), F.count_if(F.col("n_children") == 0).alias("leaves")).where("tokens > 0 or leaves > 0")
    owned = stored(owned, "owned")
    each = cut.select("conv_id", F.transform("turns", lambda t: t["print"]).alias("prints")).join(owned, "conv_id").select(F.explode("prints").alias("_node"), "tokens", "leaves")
    sums = each.groupBy("_node").agg(F.sum("tokens").alias("tokens"), F.sum("leaves").alias("leaves"))
    whole = owned.agg(F.sum("tokens").alias("tokens"), F.sum("leaves").alias("leaves")).select(_root().alias("_node"), "tokens", "leaves")
    # of what the smallest member owns, only what is from here on counts
    own = owned.select(F.col("conv_id").alias("_owner"), F.col("tokens").alias("own"))
    down = _running(nodes, ("below",), segment, back=True).join(own, F.col("conv_id") == F.col("_owner"), "left").withColumn("above", F.coalesce("own", F.lit(0)) - F.col("below"))
    told = _with_parents(stored(down.select("print", "parent", "depth", "conv_id", "n_convs", "n_children", "ends_sha256", "above"), "down"), many)
    summed = told.join(sums.unionByName(whole), F.col("print") == F.col("_node"), "left")
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(0)).cast("long").alias("n_leaves"), (F.coalesce("tokens", F.lit(0)) - F.col("above")).cast("long").alias("saved_tokens"), "ends_sha256")


#: The same nodes by cumulative strings of digests, for DuckDB; crc32 bit by bit.
TRIE_SQL = r"""WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM src)),
taken AS (SELECT i.conv_id, s.pos, s.role, s.text FROM ids i JOIN src s ON s.conv_id = i.base AND s.pos <= i.h
  UNION ALL SELECT s.conv_id, 1000 + s.pos, s.role, s.text FROM ids i JOIN src s ON s.conv_id = i.conv_id AND s.pos > i.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
  FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
prefixes AS (
  SELECT conv_id, depth, words, path, left(path, length(path) - 32) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM rebuilt
  UNION ALL SELECT i.conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = i.conv_id) FROM ids i),
nodes AS (
  SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM prefixes GROUP BY path),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT p.path, n.words * (n.n_convs - 1) AS saved, (k.n IS NULL)::INT AS leaf
  FROM nodes n JOIN prefixes e ON e.conv_id = n.conv_id AND e.depth <= n.depth JOIN nodes p ON p.path = e.path LEFT JOIN kids k ON k.parent = n.path),
sums AS (SELECT path, sum(saved) AS saved, sum(leaf) AS leaves FROM below GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.parent LEFT JOIN kids k ON k.parent = n.path JOIN sums s ON s.path = n.path
"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of that with its id rounded down to twenties.

    Rows without a conv_id belong to no conversation.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    take = F.crc32(F.col("conv_id").cast("string")) % 4
    turns, convs = replayed(ordered_turns(conversations), take, F.col("conv_id") - F.col("conv_id") % 20)
    return prefix_trie(turns, stored(convs, "sizes"))
