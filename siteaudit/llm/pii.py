"""Personal data by patterns and a skip-chain conditional random field.

Base spans are matches of fixed patterns (email, IPv4, payment card, phone) with
their checks. The field then labels the remaining candidate tokens: maximal runs
without white space that hold a digit or `@`, and bracketed or spaced runs of such
tokens. Nodes are candidates; a chain edge joins candidates at most `NEAR`
characters apart; skip edges tie all candidates of the document with the same key
(its digits, or its lower-case letters before `@`), however distant and however many.
Nodes inside a base span are clamped to its kind, so their skip edges to all others
of the key are a constant of each, the skip weight for every one of the kind. The
others of a key are tied through a hub, whose edges are as strong as makes any two
of them agree as over one skip edge; so a key of m candidates costs m edges. Loopy
belief propagation on the sum-product rule sweeps until messages change by less than
`STILL`; a candidate whose marginal for a kind is at least `KEEP` becomes a span of
the kind, unless it overlaps a base span. Base spans stay as they are.

Emission, chain and skip weights are fitted together by pseudo-likelihood on a bounded
sample of documents (about `SAMPLE`, by hash, each whole): every candidate's label given
its shape and its neighbours' labels, which are the base kinds. Base kinds follow from
shapes alone, so every candidate is seen twice, once without its shape: there the edges
have to tell. A candidate in no base span whose key is that of one isn't an example of
a label but a question, and is left out. Tasks send counts of equal examples, not texts.

Candidates of documents are found in whole texts; a document without a digit or `@` has
none, which is exact. All steps take time in proportion to the text, also for runs of a
million characters without white space.

Nulls and empty texts have no spans. An empty table gives an empty result. Repeated rows
get the same result, ties between kinds the first of `KINDS`. A giant text takes memory
in proportion to itself. Extra columns pass through untouched, also one named spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .shared import about, free_name, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample, about.
SAMPLE = 4_000
NEAR, KEEP = 40, 0.8
#: Variance of the normal prior on emission weights, and on the two edge weights.
PRIOR, EDGE_PRIOR = 10.0, 10.0
#: Sweeps end at the first that changes no message by more; after CALM sweeps messages are damped, which stops swings.
STILL, CALM, ROUNDS = 1e-9, 100, 10_000

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts with a whole run of digits and takes whole runs, so nothing is looked at twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN, _MARK = re.compile(r"\S+"), re.compile("[0-9@]")
_DIGITS = re.compile(r"[^0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans in order of their start, then of their kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = _DIGITS.sub("", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")


def _emails(text: str) -> Iterator[re.Match]:
    """EMAIL.finditer(text), in linear time: a match starts with the run of local characters before an `@`."""
    done, at = 0, text.find("@")
    local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
    while at >= 0:
        s = at
        while s > done and text[s - 1] in local:
            s -= 1
        m = EMAIL.match(text, s) if s < at else None
        if m:
            done = m.end()
            yield m
        at = text.find("@", max(at + 1, done))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or `@`, without edge punctuation."""
    out = []
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        if not _MARK.search(text, s, e):
            continue
        while s < e and not (text[s].isalnum() or text[s] == "+"):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if s < e:
            out.append((s, e))
    # A phone number or card may be written in groups: join digit groups that are one space apart.
    joined: list[tuple[int, int]] = []
    digits = 0
    for s, e in out:
        size = len(_DIGITS.sub("", text[s:e])) if _GROUPS.fullmatch(text, s, e) else 99
        if joined and s - joined[-1][1] <= 3 and size + digits <= 19 and _GROUPS.fullmatch(text, joined[-1][1], s):
            joined[-1], digits = (joined[-1][0], e), digits + size
        else:
            joined.append((s, e))
            digits = size
    return joined


#: What a number written in groups is made of.
_GROUPS = re.compile(r"[0-9+() .-]*+")


def key_of(token: str) -> str:
    """What repeated or similar tokens share; empty: nothing."""
    if "@" in token:
        return token.partition("@")[0].lower()
    d = _DIGITS.sub("", token)
    if len(d) >= 7 and len(d) >= 0.6 * len(token):
        return d[-10:]
    return ""


N_FEATURES = 16


def shape(token: str) -> np.ndarray:
    d = _DIGITS.sub("", token)
    n = len(d)
    letters = sum(c.isalpha() for c in token)
    parts = token.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    host = token.rpartition("@")[2] if "@" in token else ""
    return np.array(
        [
            1.0, "@" in token and not token.startswith("@"), bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host)), quad, len(parts) == 4 and not quad,
            token.startswith("+"), "(" in token or ")" in token, letters == 0, letters > 0 and n > 0, n < 7, 7 <= n <= 11, 12 <= n <= 19, n > 19,
            12 <= n <= 19 and letters == 0 and luhn(d), n == 10 and letters == 0, "-" in token,
        ],
        float,
    )


@dataclass
class Field:
    """Emission weights (kinds + 1 for none, features) and the weights of equal labels along edges."""

    weights: np.ndarray
    chain: float
    skip: float


def kinds_of(spans: list[Span], nodes: list[tuple[int, int]]) -> list[tuple[int, bool]]:
    """Of each node, in order, the kind of the first base span that holds it (0: none), and whether one overlaps it."""
    out, active, at = [], [], 0
    for s, e in nodes:
        while at < len(spans) and spans[at][1] < e:
            active.append(spans[at])
            at += 1
        active = [x for x in active if x[2] > s]
        holds = next((KINDS.index(k) + 1 for k, a, b in active if a <= s + 1 and e <= b + 1), 0)
        out.append((holds, bool(active)))
    return out


def edges_of(nodes: list[tuple[int, int]], keys: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of near neighbours and skip edges to the next node of the same key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR]
    skip, last = [], {}
    for i, k in enumerate(keys):
        if k:
            if k in last:
                skip.append((last[k], i))
            last[k] = i
    return chain, skip


def ties_of(keys: list[str], kinds: list[int], labels: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many clamped nodes (kind > 0) of its key each other node has, by label, and edges of these others to their key's hub.

    Hubs are numbered from len(keys) on; a key with fewer than two such nodes has none.
    """
    fixed: dict[str, np.ndarray] = {}
    others: dict[str, list[int]] = {}
    for i, (key, kind) in enumerate(zip(keys, kinds)):
        if key and kind:
            fixed.setdefault(key, np.zeros(labels))[kind] += 1
        elif key:
            others.setdefault(key, []).append(i)
    held, hubs, hub = np.zeros((len(keys), labels)), [], len(keys)
    for key, nodes in others.items():
        if key in fixed:
            held[nodes] = fixed[key]
        if len(nodes) > 1:
            hubs += [(i, hub) for i in nodes]
            hub += 1
    return held, hubs


def hub_weight(skip: float, labels: int) -> float:
    """The weight of two edges in a row that are together one edge of weight skip."""
    e = np.exp(skip)
    return float(np.log(e + np.sqrt(e * e + (labels - 2) * e - (labels - 1))))


def marginals(
    emit: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], field: Field, rounds: int = ROUNDS, hubs: list[tuple[int, int]] | None = None
) -> np.ndarray:
    """Node marginals by loopy belief propagation; exact on trees after enough rounds."""
    n, k = emit.shape
    if not n:
        return emit
    pairs = [(a, b, field.chain) for a, b in chain] + [(a, b, field.skip) for a, b in skip]
    if hubs:
        strong = hub_weight(field.skip, k)
        pairs += [(a, b, strong) for a, b in hubs]
        emit = np.concatenate([emit, np.zeros((hubs[-1][1] + 1 - n, k))])
    phi = np.exp(emit - emit.max(1, keepdims=True))
    if not pairs:
        return phi / phi.sum(1, keepdims=True)
    src = np.array([x for a, b, _ in pairs for x in (a, b)])
    dst = np.array([x for a, b, _ in pairs for x in (b, a)])
    gain = np.exp(np.array([w for _, _, w in pairs for _ in (0, 1)]))
    back = np.arange(len(src)) ^ 1
    msg = np.zeros((len(src), k))
    for r in range(rounds):
        total = np.log(phi + 1e-300)
        np.add.at(total, dst, msg)
        into = total[src] - msg[back]
        into = np.exp(into - into.max(1, keepdims=True))
        out = into.sum(1, keepdims=True) + (gain[:, None] - 1) * into
        new = np.log(out / out.sum(1, keepdims=True))
        done = np.abs(new - msg).max() < STILL
        msg = new if r < CALM else (new + msg) / 2
        if done:
            break
    total = np.log(phi + 1e-300)
    np.add.at(total, dst, msg)
    p = np.exp(total - total.max(1, keepdims=True))[:n]
    return p / p.sum(1, keepdims=True)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that the field adds."""
    base = base_spans(text)
    nodes = candidates(text)
    known = kinds_of(base, nodes)
    free = [i for i, (k, touched) in enumerate(known) if not k and not touched]
    if not free:
        return base, base
    tokens = [text[s:e] for s, e in nodes]
    emit = np.stack([shape(t) for t in tokens]) @ field.weights.T
    for i, (k, _) in enumerate(known):
        if k:
            emit[i] = -50.0
            emit[i, k] = 0.0
    keys = [key_of(t) for t in tokens]
    held, hubs = ties_of(keys, [k for k, _ in known], emit.shape[1])
    p = marginals(emit + field.skip * held, edges_of(nodes, keys)[0], [], field, hubs=hubs)
    more = []
    for i in free:
        k = int(p[i, 1:].argmax()) + 1
        if p[i, k] >= KEEP:
            more.append((KINDS[k - 1], *nodes[i]))
    return base, sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


#: An example of the fit: shape as bits (-1: not shown), label, and neighbours by label along chain and skip edges.
_EXAMPLE = ["shape", "y", *(f"chain{i}" for i in range(len(KINDS) + 1)), *(f"skip{i}" for i in range(len(KINDS) + 1))]
_BITS = 1 << np.arange(N_FEATURES)


def examples(text: str) -> list[tuple[int, ...]]:
    """The examples that a text gives, each candidate with and without its shape."""
    base, nodes = base_spans(text), candidates(text)
    kinds = [k for k, _ in kinds_of(base, nodes)]
    tokens = [text[s:e] for s, e in nodes]
    keys = [key_of(t) for t in tokens]
    known: dict[str, np.ndarray] = {}
    for key, y in zip(keys, kinds):
        if key:
            known.setdefault(key, np.zeros(len(KINDS) + 1, np.int64))[y] += 1
    open_ = [not y and bool(key) and known[key][1:].any() for key, y in zip(keys, kinds)]
    near = np.zeros((len(nodes), len(KINDS) + 1), np.int64)
    for a, b in edges_of(nodes, keys)[0]:
        if not open_[a] and not open_[b]:
            near[a, kinds[b]] += 1
            near[b, kinds[a]] += 1
    out = []
    for i, (key, y) in enumerate(zip(keys, kinds)):
        if open_[i]:
            continue
        same = known[key].copy() if key else np.zeros(len(KINDS) + 1, np.int64)
        same[y] -= bool(key)
        same[0] = 0 if same[1:].any() else same[0]  # those are questions, too
        rest = [y, *near[i].tolist(), *same.tolist()]
        out += [(int(shape(tokens[i]).astype(np.int64) @ _BITS), *rest), (-1, *rest)]
    return out


def fit(rows: np.ndarray, times: np.ndarray) -> Field:
    """A field from distinct examples and how often each occurs, by pseudo-likelihood."""
    k = len(KINDS) + 1
    w, edges = np.zeros((k, N_FEATURES)), np.zeros(2)
    w[0, 0] = 2.0
    if len(rows):
        bits, y = rows[:, 0], np.eye(k)[rows[:, 1]]
        x = np.where(bits[:, None] < 0, np.arange(N_FEATURES) == 0, (np.maximum(bits, 0)[:, None] & _BITS) > 0).astype(float)
        beside = np.stack([rows[:, 2 : 2 + k], rows[:, 2 + k : 2 + 2 * k]]).astype(float)  # chain, skip
        c = times.astype(float)[:, None]
        n, flat_mean, flat_square = c.sum(), 0.0, 0.0
        for r in range(1, 601):
            z = x @ w.T + edges[0] * beside[0] + edges[1] * beside[1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = c * (y - p)
            g = np.concatenate([(off.T @ x - w / PRIOR).ravel(), (off[None] * beside).sum((1, 2)) - edges / EDGE_PRIOR]) / n * 100
            flat_mean, flat_square = 0.9 * flat_mean + 0.1 * g, 0.99 * flat_square + 0.01 * g * g
            step = 0.1 * (flat_mean / (1 - 0.9**r)) / (np.sqrt(flat_square / (1 - 0.99**r)) + 1e-8)
            w, edges = w + step[:-2].reshape(w.shape), edges + step[-2:]
    # Equal labels along an edge can't count against each other: the messages and hubs need weights of 0 at least.
    return Field(w, max(0.0, float(edges[0])), max(0.0, float(edges[1])))


def fit_texts(texts: list[str]) -> Field:
    rows, times = np.unique(np.array([e for t in texts for e in examples(t)], np.int64).reshape(-1, len(_EXAMPLE)), axis=0, return_counts=True)
    return fit(rows, times)


_KIND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_PII_BYTES = np.zeros(256, bool)
_PII_BYTES[[*range(48, 58), 64]] = True


def trained(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Field:
    """A field from a bounded sample of documents that hold a digit or `@`; the driver gets distinct examples with counts."""
    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("t"), F.xxhash64(F.lit(11), key, text).alias("h"))
    some = about(some, F.col("h"), SAMPLE, some.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                rows, times = np.unique(np.array(examples(t.as_py()), np.int64).reshape(-1, len(_EXAMPLE)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows.T), pa.array(times)], names=[*_EXAMPLE, "n"])

    found = some.select("t").mapInArrow(run, ", ".join(f"{c} long" for c in (*_EXAMPLE, "n"))).groupBy(*_EXAMPLE).agg(F.sum("n").alias("n")).toArrow()
    found = found.sort_by([(c, "ascending") for c in _EXAMPLE])
    rows = np.stack([found.column(c).to_numpy() for c in _EXAMPLE], 1) if found.num_rows else np.zeros((0, len(_EXAMPLE)), np.int64)
    return fit(rows, found.column("n").to_numpy())


def find_personal_data(docs: DataFrame, field: Field, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with an array of spans (kind, start, end, base); the column's name."""
    name = free_name(docs, "spans")
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for block in tb.blocks(batch.column(batch.schema.get_field_index(text))):
                marks = np.concatenate(([0], np.cumsum(_PII_BYTES[block.raw])))
                some = marks[block.offsets[1:]] > marks[block.offsets[:-1]]
                for r in range(block.hi - block.lo):
                    if not some[r]:
                        found.append([])
                        continue
                    base, spans = all_spans(block.text(r), held.value)
                    own = set(base)
                    found.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, _KIND)])), name


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def base_digest(text: str) -> str:
    return hashlib.sha256(spans_text(base_spans(text)).encode()).hexdigest()


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """The digest of op4; counts are those of base spans, `spans` has the method's too."""
    docs = docs.select("doc_id", "text")
    out, name = find_personal_data(docs, trained(docs))
    out = out.select("doc_id", name)
    base = F.filter(name, lambda s: s["base"])
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col(name)).alias("spans"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their kinds; of spans that overlap the first stands for all."""
    pieces, done = [], 0
    for kind, s, e in spans:
        if s >= done:
            pieces += [text[done:s], f"<{kind}>"]
        done = max(done, e)
    return "".join([*pieces, text[done:]])


def mask_personal_data(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; nulls stay null."""
    held = docs.sparkSession.sparkContext.broadcast(trained(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [t if not t or not _MARK.search(t) else masked(t, all_spans(t, held.value)[1]) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, text, pa.array(new, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)
