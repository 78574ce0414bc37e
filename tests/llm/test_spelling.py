"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from occspark.llm import spelling


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(docs, least=7, often=2, every=31):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {w: k for w, k in n.items() if k >= often and len(w) >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def edited(dice, word):
    at, c = dice.randrange(len(word)), dice.choice("aabcéßÿ")
    return dice.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    stems = ["aaaaaaa", "aaaaaaab", "abababab", "international", "straßenbahn", "ÉTÉprofond", "Übermäßig", "aaaabaaaa"]
    stems += ["".join(dice.choice("abc") for _ in range(dice.randrange(7, 12))) for _ in range(60)]
    chain = ["wwwwwwwwww", "wwwwwwwwwx", "wwwwwwwwxx", "wwwwwwwxxx"]
    words = [w for w in stems for _ in range(2)] + [edited(dice, dice.choice(stems)) for _ in range(900)] + [w for k, w in enumerate(chain) for _ in range(2 * 11**k)]
    dice.shuffle(words)
    docs = [(k, dice.choice([" ", "1", "_", "—"]).join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    long = "q" * 30_000
    docs += [(None, "aaaaaaa international"), (1001, None), (1002, ""), (1003, f"{long} {long} {long}z {long}z short Xy"), (1003, f"{long}z")]
    return docs


def told(rows):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_variants_equal_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(texts)
    assert max(len({*v[4:]} | {w}) for w, v in want.items()) > 1 and any(v[2] and want[v[2]][2] for v in want.values())
    rows = spelling.spelling_variants(docs, every=31).collect()
    assert len(rows) == len(want) and told(rows) == want
    # tiles of at most three words, so that ranges are cut to single places
    assert told(spelling.spelling_variants(docs, every=31, most=3).collect()) == want
    assert told(spelling.spelling_variants(docs).collect()) == brute(texts, every=0)


def test_tiles_hold_each_pair_once(spark, texts):
    words = spark.createDataFrame([(w, v[0]) for w, v in brute(texts).items() if len(w) < 100], "word string, n long")
    rows = spelling.tiles(words, 8).collect()
    assert all(r["prefix"] == r["word"][: r["lo"]] and r["suffix"] == r["word"][len(r["word"]) - r["long"] + r["hi"] :] for r in rows)
    held = Counter((r["long"], r["lo"], r["hi"], r["prefix"], r["suffix"]) for r in rows)
    assert all(c <= 8 or hi - lo == 1 for (_, lo, hi, _, _), c in held.items())
    ranges = Counter((r["word"], r["long"]) for r in rows for _ in range(r["lo"], r["hi"]))
    assert all(c == long for (_, long), c in ranges.items())


def test_small_and_large_tiles_agree():
    dice = random.Random(6)
    words = sorted({"pre" + "".join(dice.choice("ab") for _ in range(dice.choice([3, 4]))) + "end" for _ in range(60)})
    near, first = spelling.near_in_tile(words, 10, 3, 7)
    few = spelling._small_tiles(words, spelling.np.zeros(len(words), int), spelling.np.array([(10, 3, 7)] * len(words)))
    assert near.tolist() == few[0].tolist() and first.tolist() == few[1].tolist() and near.any()


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "one two three"), (2, "singular")], "doc_id long, text string")).collect() == []


def test_query_has_the_columns_asked_for(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op13_spelling(spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    assert told(got.collect()) == brute(texts)
