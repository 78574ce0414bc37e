"""Near duplicates by bottom-k sketches from one hash function.

A document's sketch is the k least hash values of its shingle set. Inverted lists of
retained values give the overlaps, the sketch of the union estimates the similarity, and the
full sets decide. Which values of a sketch are listed follows from the overlap that two
linked documents must have: with at least T common values among s, one of the s - T + 1
rarest is common, so values that half the corpus shares need no list.

Within a list no two-by-two pairs are emitted. Every member is compared with two hubs first,
and linked members merge. Lists that still hold several components are drawn anew from their
members' full sets, where a linked pair must share one of the rarest 1 - threshold of all
values. What is then outside a list's main component is compared with the members of other
components that it may be linked with. Links that are left out join documents of one
component, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .components import connected_components
from .storage import remove, small, stored

#: Chance, for one linked pair, that its sketches look unlike. Sets T.
MISS = 1e-9


def least_overlap(k: int, threshold: Fraction) -> int:
    """The largest T with P[Binomial(k, threshold) < T] <= MISS: linked sketches share T of k."""
    p, tail = float(threshold), 0.0
    for t in range(k + 1):
        tail += comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > MISS:
            return max(1, t)
    return k


def _shingle_batches(batches: Iterator[pa.RecordBatch], words: int, k: int, full: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for first, raws in kernels.blocks(texts):
            grams, at = kernels.hash_ngrams(*kernels.hash_words(raws), words)
            signed = grams.view(np.int64)
            sizes, prints, kept = [], [], []
            for i in range(len(raws)):
                own = np.unique(signed[at[i] : at[i + 1]])
                sizes.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                kept.append(own if full else own[:k])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(raws)), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32), pa.array(np.concatenate([*kept, np.empty(0, np.int64)])))],
                names=["doc_id", "n", "fp", "values"])


def sketches(docs: DataFrame, words: int, k: int, full: bool = False) -> DataFrame:
    """(doc_id, n, fp, values): shingle set size, its 128-bit print and its k least values (or all)."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(lambda it: _shingle_batches(it, words, k, full), "doc_id long, n int, fp binary, values array<long>")


def _lists(rows: DataFrame) -> DataFrame:
    """(v, fp, n, rest, score, listed) from rows (fp, n, need, values): each set below its rarest common values.

    Two sets with at least ``need`` values in common, as both their rows say, meet in a list.
    Values that no other row has make none. listed: all values that the set is listed under,
    rarest first, in one order for all sets. rest: how many values that others have the set
    holds from this one on. score is higher the more sets share a set's values.
    """
    each = rows.select("fp", "n", "need", F.explode("values").alias("v"))
    # a table of its own: a value that very many sets hold can then be split in the join
    often = stored(each.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    shared = each.join(small(often), "v").groupBy("fp", "n", "need").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("common"), F.sum("c").alias("score"))
    kept = shared.where("size(common) >= need").withColumn("s", F.size("common"))
    listed = F.transform(F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("s") - F.col("need") + 1)), lambda x: x["v"])
    each = kept.select("fp", "n", "s", "score", listed.alias("listed")).select("fp", "n", "s", "score", "listed", F.posexplode("listed").alias("at", "v"))
    return each.withColumn("rest", F.col("s") - F.col("at")).drop("s", "at")


def _need_of_sketch(k: int, threshold: Fraction) -> Column:
    """How many values of its sketch a set must share with the sketch of any linked set."""
    t, n = float(threshold), F.col("n").cast("double")
    # a set of at most k values is its own sketch; a partner may be larger and hold values beyond its k
    small = F.greatest(F.lit(1.0), F.ceil(n * t - 1e-9) - F.greatest(F.lit(0.0), F.floor(n / t + 1e-9) - k))
    return F.when(F.col("n") > k, F.lit(least_overlap(k, threshold))).otherwise(small.cast("int"))


def _with_hubs(lists: DataFrame) -> DataFrame:
    """(a, b): every member of a list with its hubs. Hubs: the member whose values most sets share, and a random one."""
    hubs = stored(lists.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max_by("fp", F.struct("score", F.xxhash64("fp"))).alias("h0"), F.min_by("fp", F.xxhash64("fp")).alias("h1")).where("c > 1"), "hubs")
    return _distinct_pairs(lists.select("v", "fp").join(small(hubs.select("v", "h0", "h1")), "v").select(F.col("fp").alias("a"), F.explode(F.array_distinct(F.array("h0", "h1"))).alias("b")))


def _unsettled(lists: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members, with their components, of the lists that more than one component has members in; and those lists' main components."""
    tagged = lists.join(small(placed), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    sizes = tagged.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("v").agg(F.max_by("root", "c").alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("members")).where("roots > 1 and members > 2").select("v", "main")
    return tagged, stored(main, "main")


def _likely(pairs: DataFrame, reps: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and whose union's sketch allow the similarity, with na and nb."""
    side = lambda x: reps.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"s{x}"))
    p, q = threshold.numerator, threshold.denominator
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * F.lit(q) >= F.greatest("na", "nb") * F.lit(p))
    # a union of at most k values is known whole; else its k least values are a sample of it
    fewest = F.when(F.size(F.array_union("sa", "sb")) <= k, F.ceil(F.size(union) * float(threshold) - 1e-9)).otherwise(F.lit(least_overlap(k, threshold)))
    return stored(sized.where(both >= fewest).select("a", "b", "na", "nb"), "likely")


def _full_sets(fps: DataFrame, reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(fp, n, values): the whole sets of some prints (column fp), hashed anew from one document of each."""
    wanted = stored(fps.distinct().join(reps.select("fp", "first_id"), "fp"), "wanted")
    known = small(wanted)
    ids = known.select(F.col("first_id").alias("_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = sketches(own.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), words, 0, full=True)
    return stored(sets.select("fp", "n", "values").join(known.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _linked(likely: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The likely pairs whose full sets are similar enough."""
    p, q = threshold.numerator, threshold.denominator
    full = lambda x: sets.select(F.col("fp").alias(x), F.col("values").alias(f"f{x}"))
    done = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("fa", "fb")).alias("i"))
    return stored(done.where(F.col("i").cast("long") * q >= (F.col("na") + F.col("nb") - F.col("i")).cast("long") * p).select("a", "b"), "links")


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """The components after some more links, which join the components found so far as if those were nodes."""
    if links.isEmpty():
        return placed
    known = small(placed)
    of = lambda x: known.select(F.col("node").alias(f"node{x}"), F.col("root").alias(f"root{x}"))
    roots = links.join(of("a"), F.col("a") == F.col("nodea"), "left").join(of("b"), F.col("b") == F.col("nodeb"), "left")
    between = stored(roots.select(F.coalesce("roota", "a").alias("a"), F.coalesce("rootb", "b").alias("b")).where("a <> b"), "between")
    if between.isEmpty():
        return placed
    moved = connected_components(between).select(F.col("node").alias("moved"), F.col("root").alias("to"))
    remove(between)
    hung = placed.join(small(moved), F.col("root") == F.col("moved"), "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(known, F.col("moved") == F.col("node"), "left_anti").select(F.col("moved").alias("node"), F.col("to").alias("root"))
    return stored(hung.unionByName(new), "placed")


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs that are linked, of sets that ``sets`` has in full."""
    likely = _likely(pairs, reps, k, threshold)
    links = _linked(likely, sets, threshold)
    remove(likely)
    return links


def _components(reps: DataFrame, docs: DataFrame, words: int, threshold: Fraction, k: int) -> DataFrame:
    """(node, root) of all prints in ``reps`` that a link reaches, and maybe of others.

    What comes after the links to hubs is left out where no list holds two components.
    """
    p, q = threshold.numerator, threshold.denominator
    lists = stored(_lists(reps.withColumn("need", _need_of_sketch(k, threshold))).drop("listed"), "lists")
    likely = _likely(_with_hubs(lists), reps, k, threshold)
    sets = _full_sets(likely.select(F.col("a").alias("fp")).union(likely.select("b")), reps, docs, words)
    placed = connected_components(_linked(likely, sets, threshold))
    remove(likely)
    remove(sets)
    # lists that still have several components: lists of the rarest values of their members' full sets, which are far fewer
    tagged, main = _unsettled(lists, placed)
    if main.isEmpty():
        return placed
    open_sets = _full_sets(tagged.join(small(main.select("v")), "v", "left_semi").select("fp"), reps, docs, words)
    need = F.ceil(F.col("n").cast("long") * p / q - 1e-9).cast("int")
    remove(lists)
    remove(main)
    lists = stored(_lists(open_sets.withColumn("need", need)), "lists")
    placed = _joined(placed, _confirmed(_with_hubs(lists), reps, open_sets, k, threshold))
    # what is outside a list's main component meets all other components, as far as the parts that others share allow
    tagged, main = _unsettled(lists, placed)
    if main.isEmpty():
        return placed
    tagged = stored(tagged.join(small(main), "v").select("v", "fp", "n", "rest", "listed", "root", (F.col("root") != F.col("main")).alias("out")), "tagged")
    left, right = (tagged.select("v", *[F.col(c).alias(f"{c}{x}") for c in ("fp", "n", "rest", "root", "out", "listed")]) for x in "ab")
    # a pair counts in the first list that both are in; all that they share comes from there on
    most = F.least("resta", "restb")
    may = (F.col("roota") != F.col("rootb")) & (~F.col("outb") | (F.col("fpa") < F.col("fpb"))) & (most * F.lit(q) >= (F.col("na") + F.col("nb") - most) * F.lit(p))
    once = F.get(F.array_intersect("listeda", "listedb"), F.lit(0)) == F.col("v")
    rest = left.where("outa").join(right.withColumnRenamed("v", "w"), (F.col("v") == F.col("w")) & may & once)
    placed = _joined(placed, _confirmed(_distinct_pairs(rest.select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))), reps, open_sets, k, threshold))
    for table in (lists, main, tagged, open_sets):
        remove(table)
    return placed


def near_duplicates(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), k: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``threshold``; component_id is the least doc_id that links reach.
    Null or blank texts have no shingles, are linked with nothing and stand for themselves.
    Equal sets count as one node, so repeated rows and large groups of copies cost one
    sketch. Rows with a null doc_id keep it and never name a component that has another id.
    Very long texts are hashed whole, other columns play no part, and no rows give none.
    """
    prints = stored(sketches(docs, words, k), "prints")
    reps = stored(prints.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("values").alias("values")), "reps")
    roots = _components(reps, docs, words, threshold, k)
    firsts = reps.select("fp", "first_id")
    named = stored(firsts.join(small(roots), F.col("fp") == F.col("node")).select("fp", "first_id", "root"), "named")
    least = stored(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    # only sets whose component has a smaller id than their own first: few rows to join with all documents
    moved = stored(named.join(small(least), "root").where("not (component_id <=> first_id)").select(F.col("fp").alias("moved_fp"), "component_id"), "moved")
    owners = stored(firsts.join(small(moved), F.col("fp") == F.col("moved_fp"), "left").select(F.col("fp").alias("owned_fp"), F.coalesce("component_id", "first_id").alias("component_id")), "owners")
    for table in (reps, roots, named, least, moved):
        remove(table)
    told = prints.select("doc_id", "n", "fp").join(owners, F.col("fp") == F.col("owned_fp"), "left")
    return told.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 % of three-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, Fraction(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
