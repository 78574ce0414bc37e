"""Prefix tries against a plain tree."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from occspark.llm import trie


def brute(rows, take=lambda c: zlib.crc32(str(c).encode()) % 4, base=lambda c: c - c % 20):
    """Nodes by their conversations' paths."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(base(c), [])[: take(c)] + v[take(c) :]) for c, v in own.items()}
    paths = {v[:d] for v in built.values() for d in range(len(v) + 1)}
    members = {p: sorted(c for c, v in built.items() if v[: len(p)] == p) for p in paths}
    kids = {p: [q for q in paths if len(q) == len(p) + 1 and q[:-1] == p] for p in paths}

    def words(p):
        return len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0

    out = []
    for p in paths:
        below = [q for q in paths if q[: len(p)] == p]
        ends = ",".join(str(c) for c in members[p] if built[c] == p)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), sum(not kids[q] for q in below), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, part int, key string"


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(7)
    starts = [("system", "You are kind."), ("user", "Hi  there\n you"), ("user", ""), (None, None), ("", "x y z")]
    out = []
    for c in [*range(60), *range(200, 215), 1_000_007, -3, -40]:
        out += [(c, None if dice.random() < 0.1 else 3 * k - 2, *(dice.choice(starts[:2]) if k < 2 else dice.choice(starts))) for k in range(dice.randrange(1, 7))]
    out += [(77, k, "user", f"t{k // 2}") for k in range(40)] + [(78, k, "user", f"t{k // 2}") for k in range(40)]  # long ones, alike to the end
    out += [(300 + k, 0, "user", "same") for k in range(40)]  # copies
    out += [(5, 2, "user", "again")] * 3 + [(None, 1, "user", "no conversation")]
    dice.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("bounds", [{}, {"segment": 2, "shard_turns": 3, "many": 1}, {"segment": 7, "shard_turns": 40, "many": 3}])
def test_nodes_equal_a_plain_tree(spark, tmp_path, rows, frame, bounds):
    turns, convs = trie.replayed(trie.ordered_turns(frame), trie.F.crc32(trie.F.col("conv_id").cast("string")) % 4, trie.F.col("conv_id") - trie.F.col("conv_id") % 20)
    # Python's remainder of negative numbers differs from SQL's
    assert told(trie.prefix_trie(turns, convs, **bounds)) == brute(rows, base=lambda c: c - (c % 20 if c >= 0 else -(-c % 20)))


def test_a_conversation_in_many_ranges_is_ranked_through(spark):
    rows = [(4, 400 - k, "user", str(k)) for k in range(400)] + [(9, 1, "user", "x")] * 50
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.ordered_turns(frame)
    assert got.select("part").distinct().count() > 1 and sorted(r["pos"] for r in got.where("conv_id = 9").collect()) == [*range(1, 51)]
    none = lambda c: trie.F.lit(0)
    turns, convs = trie.replayed(got, none(0), trie.F.col("conv_id"))
    assert told(trie.prefix_trie(turns, convs, segment=16)) == brute(rows, take=lambda c: 0, base=lambda c: c)


def test_walk_takes_the_smallest_member_and_ends():
    turn = lambda d, k: {"depth": d, "key": k, "words": 1, "print": k * d}
    unit = lambda c, keys, more=False, parts=1: {"conv_id": c, "seg": 0, "start": b"", "first": keys[0], "more": more, "parts": parts, "turns": [turn(d + 1, k) for d, k in enumerate(keys)]}
    got = {n[0]: n[3:] for n in trie.walk([unit(9, [b"a", b"b"]), unit(2, [b"a", b"b", b"c"]), unit(5, [b"a"]), unit(7, [b"a", b"b"], more=True, parts=2)])}
    assert got[b"a"][:2] == (2, 4) and got[b"bb"][:2] == (2, 3) and got[b"ccc"][:2] == (2, 1)
    assert got[b"a"][4] == trie.ends_digest([5]) and got[b"bb"][4] == trie.ends_digest([9])  # 7 goes on elsewhere


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns, convs = trie.replayed(trie.ordered_turns(empty), trie.F.lit(0), trie.F.col("conv_id"))
    assert trie.prefix_trie(turns, convs).collect() == []


def test_query_equals_its_sql(spark, tmp_path, rows, frame):
    frame.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op12_trie(spark, str(tmp_path))
    assert [t for _, t in got.dtypes[:7]] == ["bigint"] * 7
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert told(got) == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.TRIE_SQL})").fetchall(), key=repr)
