"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

The nodes of a document's field are its words with a digit or an ``@``; other words can't be
part of an entity and cut the chain, but the two before and the one behind a node are its
features, so cues such as "call" are learnt. Neighbouring words share chain potentials; repeated
words, and words that end in the same digits or begin like the same address, share skip
potentials however far apart they are, so a mention that the patterns miss takes the label
of one that they find. Occurrences are linked as a binary tree, so a word that occurs a thousand
times has a thousand links and a label is at most about twenty from all of them. Loopy
sum-product message passing, until nothing changes, gives the marginals; nodes inside
pattern matches are fixed.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
# Patterns fixed by the contract. Digits and dots are taken possessively: the same matches in linear time.
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]++@?+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT_RUN = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile("[^\x20\x09-\x0d]+")
_MARKED = re.compile("[0-9@]")
_OUTER = ".,;:!?\"'<>[]{}"

#: What a document with a match of some kind holds, for the choice of those that the field is fitted on.
_MAY_HOLD = "@[A-Za-z0-9-]|[+][0-9]|[0-9][.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]|[0-9]([ -]?[0-9]){15}"
#: Documents that the field is fitted on at most, those of least hash.
TRAIN_DOCS = 400
#: Longer documents aren't fitted on.
TRAIN_CHARS = 20_000
#: An entity is added if its marginal is over this.
CERTAIN = 0.7
#: Messages are settled when a damped step changes none by this much.
TOLERANCE = 1e-4
#: Rounds that any document may take; each node allows four more, so that evidence can cross the longest chain.
LEAST_ROUNDS = 200
_FEATURES = 19
#: Classes that the words around nodes are hashed to, for each place. Class 0 of all is no evidence.
CONTEXT_CLASSES = 256
_CONTEXTS = 1 + 3 * CONTEXT_CLASSES
#: Ridge of the weights of context words: a word speaks as far as many mentions have it.
CONTEXT_RIDGE = 3e-3


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches that hold, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    done = 0
    for m in _LOCAL_PART.finditer(text) if "@" in text else ():  # whole runs of address characters, each once
        start = max(done, m.start())
        if text[m.end() - 1] == "@" and start < m.end() - 1 and (domain := _DOMAIN.match(text, m.end())):
            done = domain.end()
            found.append(("email", start, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _DIGIT_RUN.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(own := _digits(m[0])) <= 19 and luhn(own):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


@dataclass(frozen=True)
class Field:
    """Log-linear weights: features x labels, chain labels x labels, (same, similar) x labels, context classes x labels. Label 0 is none."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    context: np.ndarray = dataclass_field(default_factory=lambda: np.zeros((_CONTEXTS, 1 + len(KINDS))))


@dataclass
class Graph:
    """A document's nodes (start, end), features, fixed labels (-1: free), edges (i, j, kind: 0 chain, 1 same, 2 similar) and nodes x 3 context classes."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    fixed: np.ndarray
    edges: np.ndarray
    context: np.ndarray = dataclass_field(default_factory=lambda: np.zeros((0, 3), np.int64))


def _context(word: str, place: int) -> int:
    """The class of a word at one of the three places around a node; all nodes are one word there."""
    own = "0" if _MARKED.search(word) else word.strip(_OUTER + "()").lower()
    return 1 + place * CONTEXT_CLASSES + zlib.crc32(own.encode()) % CONTEXT_CLASSES


def _features(token: str, before: bool, after: bool) -> np.ndarray:
    digits = _digits(token)
    n = len(digits)
    local, _, domain = token.partition("@")
    parts = token.split(".")
    f = [True, bool(domain), bool(local and "." in domain.strip(".")), n == 0, 1 <= n <= 2, 3 <= n <= 4, 5 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n > 19,
         token.startswith("+"), len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts), 16 <= n <= 19 and not any(map(str.isalpha, token)) and luhn(digits),
         any(c.isalpha() for c in token), token.isdecimal(), "(" in token or ")" in token, "-" in token, before, after]
    return np.array(f, np.float64)


def build(text: str, spans: list[tuple[str, int, int]]) -> Graph:
    """The field of a text whose pattern matches are ``spans``."""
    nodes, chain, context, last_end = [], [], [], None
    before, before_that, open_node = "", "", False
    for m in _NODE.finditer(text):
        earlier = (before, before_that)
        before, before_that = m[0], before
        if open_node:
            context[-1][2] = _context(m[0], 2)
            open_node = False
        if not _MARKED.search(m[0]):
            continue
        own = m[0].strip(_OUTER)
        if not own:
            continue
        start = m.start() + m[0].index(own)
        if last_end is not None and not text[last_end : m.start()].strip("\x20\x09\x0a\x0b\x0c\x0d"):
            chain.append(len(nodes))
        nodes.append((start, start + len(own), own))
        context.append([_context(w, k) if w else 0 for k, w in enumerate(earlier)] + [0])
        open_node = True
        last_end = m.end()
    follows = set(chain)
    features = np.array([_features(t, k in follows, k + 1 in follows) for k, (_, _, t) in enumerate(nodes)]).reshape(len(nodes), _FEATURES)
    fixed = np.full(len(nodes), -1)
    starts = np.array([s for s, _, _ in nodes], np.int64)
    ends = np.array([e for _, e, _ in nodes], np.int64)
    for kind, low, high in reversed(spans):  # of overlapping kinds, the first listed holds
        fixed[np.searchsorted(ends, low, "right") : np.searchsorted(starts, high, "left")] = 1 + KINDS.index(kind)
    edges = [(k - 1, k, 0) for k in chain]
    alike: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for k, (_, _, token) in enumerate(nodes):
        digits, local = _digits(token), token.lower().partition("@")[0]
        keys = (token.lower() if len(digits) >= 3 or "@" in token else None, f"@{local}" if "@" in token and len(local) >= 3 else (digits[-7:] if len(digits) >= 7 else None))
        first = keys[0] not in alike[0]
        for same, key in enumerate(keys):
            if key is not None and (same == 0 or first):  # similar words are linked at the first occurrence of each
                members = alike[same].setdefault(key, [])
                if members:
                    edges.append((members[(len(members) - 1) // 2], k, 1 + same))
                members.append(k)
    return Graph([(s, e) for s, e, _ in nodes], features, fixed, np.array(edges, np.int64).reshape(-1, 3), np.array(context, np.int64).reshape(-1, 3))


def marginals(graph: Graph, field: Field) -> np.ndarray:
    """(node, label) marginals by damped loopy sum-product, in logarithms; ``fixed`` labels are certain."""
    labels = field.chain.shape[0]
    unary = graph.features @ field.unary
    if len(graph.context):
        unary += field.context[graph.context].sum(1)
    known = np.flatnonzero(graph.fixed >= 0)
    unary[known] = -1e4
    unary[known, graph.fixed[known]] = 0
    if len(graph.edges):
        i, j, kind = graph.edges.T
        same = np.zeros((2, labels, labels))
        same[:, np.arange(labels), np.arange(labels)] = field.skip
        forward = np.concatenate([field.chain[None], same])[kind]
        pot = np.concatenate([forward, forward.transpose(0, 2, 1)])
        source, target, back = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        message = np.zeros((2 * len(i), labels))
        active = np.arange(2 * len(i))  # messages that what they come from may still change
        for _ in range(LEAST_ROUNDS + 4 * len(unary)):
            out = (unary[source[active]] - message[back[active]])[:, :, None] + pot[active]
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            step = 0.5 * (new - message[active])
            message[active] += step
            np.add.at(unary, target[active], step)
            moved = active[np.abs(step).max(1) >= TOLERANCE]
            if not len(moved):
                break
            touched, again = np.zeros(len(unary), bool), np.zeros(len(message), bool)
            touched[target[moved]] = again[moved] = True
            active = np.flatnonzero(touched[source] | again)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, spans: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """What the field adds: runs of free neighbouring words with one entity label."""
    if not _MARKED.search(text):
        return []
    graph = build(text, spans)
    if not len(graph.spans) or not (graph.fixed < 0).any():
        return []
    p = marginals(graph, field)
    label = np.where((graph.fixed < 0) & (p.max(1) > CERTAIN), p.argmax(1), 0)
    joined = {int(k) for i, k, kind in graph.edges if kind == 0 and label[i] == label[k] > 0}
    out: list[tuple[str, int, int]] = []
    for k in np.flatnonzero(label):
        start, end = graph.spans[k]
        if int(k) in joined:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((KINDS[label[k] - 1], start, end))
    taken = sorted((s, e) for _, s, e in spans)
    return [x for x in out if not any(s < x[2] and e > x[1] for s, e in taken)] if len(taken) < 50 else _apart(out, taken)


def _apart(new: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken])
    return [x for x in new if (k := np.searchsorted(starts, x[2], "left")) == 0 or reach[k - 1] <= x[1]]


def all_spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(pattern matches, all spans by kind as listed, then start)."""
    base = base_spans(text or "")
    extra = added_spans(text or "", base, field)
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if extra else base


def _echo(kind: str, mention: str, dice: random.Random) -> str:
    """The same entity as people write it elsewhere: without the mark that the patterns need."""
    digits = _digits(mention)
    if kind == "email":
        return dice.choice([mention.upper(), mention.partition("@")[0] + "@" + mention.partition("@")[2].partition(".")[0]])
    if kind == "phone":
        return dice.choice([digits, digits[-10:], mention.lstrip("+"), f"0{mention.lstrip('+').partition(' ')[2]}", f"{digits[-10:-7]}-{digits[-7:]}", f"00{digits}"])
    if kind == "card":
        return dice.choice([digits, "/".join(digits[k : k + 4] for k in range(0, len(digits), 4)), digits[:4] + "." + digits[4:]])
    return dice.choice([mention.replace(".", "-"), mention + ":" + str(dice.randrange(80, 9000)), mention + "/24"])


def _instance(text: str, dice: random.Random) -> tuple[Graph, np.ndarray] | None:
    """A graph and its labels: the text, half of its entities echoed behind, and numbers that are nothing.

    Half of the echoes stand between the words around their mention, other echoes and numbers between any words of the text.
    """
    spans = base_spans(text)
    if not spans:
        return None
    lines, wanted, size = [text], [], len(text)
    words = [w for w in _NODE.findall(text) if not _MARKED.search(w)] or ["x"]
    for kind, s, e in spans:
        if dice.random() < 0.5:
            echo = _echo(kind, text[s:e], dice)
            around = [*_NODE.findall(text[max(0, s - 100) : s])[-2:], *_NODE.findall(text[e : e + 100])[:1]] if dice.random() < 0.5 else []
            around = around if len(around) == 3 and not any(map(_MARKED.search, around)) else dice.choices(words, k=3)
            head = f"\n{around[0]} {around[1]} "
            lines.append(f"{head}{echo} {around[2]}")
            wanted.append((kind, size + len(head), size + len(head) + len(echo)))
            size += len(lines[-1])
    for _ in range(2):
        noise = dice.choice([str(dice.randrange(1900, 2100)), f"{dice.randrange(100)}.{dice.randrange(10)}", str(dice.randrange(10**6, 10**9)), f"{dice.randrange(10**4)}-{dice.randrange(10**3)}", str(dice.randrange(10**15, 10**16 - 1) * 10 + 7), f"v{dice.randrange(9)}.{dice.randrange(99)}"])
        around = dice.choices(words, k=3)
        lines.append(f"\n{around[0]} {around[1]} {noise} {around[2]}")
    graph = build("".join(lines), [])
    labels = build("".join(lines), spans + wanted).fixed
    return graph, np.maximum(labels, 0)


def fit(texts: list[str], steps: int = 400, seed: int = 7) -> Field:
    """Weights of greatest pseudo-likelihood on texts labelled by the patterns, with their echoes; a small ridge."""
    dice = random.Random(seed)
    made = [x for x in (_instance(t, dice) for t in texts) if x is not None]
    labels = 1 + len(KINDS)
    field = Field(np.zeros((_FEATURES, labels)), np.zeros((labels, labels)), np.zeros((2, labels)))
    if not made:  # nothing to learn from: no node gets a label
        field.unary[0, 0] = 10.0
        return field
    offset = np.cumsum([0] + [len(g.spans) for g, _ in made])
    x = np.concatenate([g.features for g, _ in made])
    y = np.concatenate([l for _, l in made])
    context = np.concatenate([g.context for g, _ in made])
    edges = np.concatenate([g.edges + np.array([o, o, 0]) for (g, _), o in zip(made, offset, strict=False)])
    one = np.eye(labels)[y]
    i, j, kind = edges.T
    chain, skip = edges[kind == 0], edges[kind > 0]
    # half of the echoed nodes are seen without their own marks, so that the skip potentials have to speak
    near = np.zeros((2, len(y), labels))
    for a, b, k in skip:
        near[k - 1, a] += one[b]
        near[k - 1, b] += one[a]
    left, right = np.zeros_like(one), np.zeros_like(one)
    left[chain[:, 1]] = one[chain[:, 0]]
    right[chain[:, 0]] = one[chain[:, 1]]
    hidden = (near.sum((0, 2)) > 0) & (np.random.default_rng(seed).random(len(y)) < 0.5)
    x = x.copy()
    x[hidden, 1:] = 0
    context[hidden] = 0
    weights, ridges = (field.unary, field.chain, field.skip, field.context), (1e-4, 1e-4, 1e-4, CONTEXT_RIDGE)
    momentum = [np.zeros_like(w) for w in weights]
    for _ in range(steps):
        score = x @ field.unary + left @ field.chain + right @ field.chain.T + near[0] * field.skip[0] + near[1] * field.skip[1] + field.context[context].sum(1)
        p = np.exp(score - score.max(1, keepdims=True))
        miss = one - p / p.sum(1, keepdims=True)
        around = np.stack([np.bincount(context.ravel(), np.repeat(miss[:, k], 3), _CONTEXTS) for k in range(labels)], axis=1)
        around[0] = 0
        grads = (x.T @ miss, left.T @ miss + miss.T @ right, np.stack([(near[k] * miss).sum(0) for k in range(2)]), around)
        for w, m, g, ridge in zip(weights, momentum, grads, ridges, strict=True):
            m *= 0.9
            m += g / len(y) - ridge * w
            w += 1.0 * m
    return field


def train(docs: DataFrame) -> Field:
    """Fits on at most TRAIN_DOCS documents of least hash that may hold a match of any kind; longer ones than TRAIN_CHARS aren't fitted on."""
    marked = docs.select(F.col("text").cast("string").alias("text")).where((F.length("text") <= TRAIN_CHARS) & F.col("text").rlike(_MAY_HOLD))
    chosen = marked.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    if chosen is None:
        return fit([])
    return fit(sorted(r["text"] for r in marked.where(F.xxhash64("text") <= F.lit(chosen)).select("text").distinct().collect()))


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The counts and the hash are of the pattern matches; spans also holds what the field adds.
    A null text is empty: no spans, the hash of the empty string. Repeated rows give the same
    each; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py(), sent.value)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in _FOUND.split(", ")])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, _FOUND)


def redact(text: str | None, field: Field) -> str | None:
    """The text with each span (overlapping ones together) replaced by its kind in brackets; null stays null."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end in sorted(all_spans(text, field)[1], key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with all its columns, the text redacted, and n_chars (if there) its new length."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t.as_py(), sent.value) for t in batch.column("text")]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind if isinstance(kind, T.NumericType) else "long")))
    return out.select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs, train(docs))
