"""Toxicity by a linear-chain conditional random field over words.

Training (labels only from the rows it is given), on a bounded sample of labelled
rows: about `LABELLED` of each label, chosen by the hash of the key, so that what is
broadcast and collected has the same bound at every size of the corpus:
1. Document frequencies of words and of word beginnings (4 to 8 bytes) in toxic and in
   clean documents of the sample. Features seen in at least `MIN_DOCS` toxic documents
   whose smoothed log odds are at least `MIN_ODDS` make the lexicon, however many they
   are; log odds fall into bins.
2. Token labels by distant supervision: a token of a toxic document with a lexicon
   feature is toxic, every other token is not. The field (two labels; emission
   weights of the bins of the token's own word, of its beginning, and of either
   neighbour; transitions) is fitted by gradient ascent on the exact conditional
   likelihood of windows of `WINDOW` tokens of about `SAMPLE` whole documents of each
   label. Equal windows are one window with its count as its weight in the likelihood;
   so all windows without a feature, whatever their number, cost one of each length.
3. Document scores: a logistic function of the marginals' sum and maximum, fitted to
   the same documents, weighted back to the shares of the labels.

Scoring: tokens without a feature in reach share one emission, so runs of them are
one power of the transfer matrix. Forward-backward over the remaining tokens and
these powers is exact, and takes whole texts of any length in linear time. Spans are
words whose marginal is at least 0.5, in code points.

Nulls and empty texts have no tokens: their score is that of a text without toxic
words. Without any labelled row of either kind the lexicon is empty and all scores
are the same. An empty table gives an empty result. A key that repeats has one label,
the largest; its rows are scored each for itself. Repeated rows score alike; extra
columns pass through untouched, also one named score or spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .shared import about, cut, free_name, text_or_empty

MIN_DOCS, MIN_ODDS = 4, 3.0
#: Labelled rows of each label that training reads, those of them that the field is fitted to, and the tokens of a window.
LABELLED, SAMPLE, WINDOW = 50_000, 2_000, 64
#: Windows that the fit holds as arrays at once.
FIT_ROWS = 8_192
#: Bins of log odds; 0 is no feature.
EDGES = np.array([MIN_ODDS, 4.0, 5.0, 6.0, 7.0])
BINS = len(EDGES) + 1
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
#: Emission features: own word, own beginning, and the better of both for either neighbour.
GROUPS = 4


@dataclass
class Lexicon:
    """Sorted feature hashes with bins; a bitmap of hash heads answers most lookups."""

    keys: np.ndarray
    bins: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.bins = self.keys[order], self.bins[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int8)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            good = self.keys[place] == h[at]
            out[at[good]] = self.bins[place[good]]
        return out


def features(w: tb.Words) -> list[np.ndarray]:
    """Feature hashes of each word: the word, and its beginnings (0: too short)."""
    return [w.hashes, *(np.where(p == 0, 0, p ^ np.uint64(0x9E37 * n)) for n, p in ((n, w.prefixes(n)) for n in PREFIXES))]


def bins_of(w: tb.Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    word, *rest = (lexicon.of(h) for h in features(w))
    return word, np.maximum.reduce(rest)


def emissions(word: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(tokens x GROUPS) bins; neighbours don't reach into other texts."""
    best = np.maximum(word, start)
    before, after = np.zeros_like(best), np.zeros_like(best)
    before[1:], after[:-1] = best[:-1], best[1:]
    edges = first[1:-1]
    before[edges[edges < len(best)]] = 0
    after[edges[edges > 0] - 1] = 0
    return np.stack([word, start, before, after], axis=1)


@dataclass
class Model:
    lexicon: Lexicon
    #: Emission score of label 1 over 0 by group and bin, its bias, and transition scores [from][to].
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    #: Document score: intercept, weight of the marginals' sum (log) and of their maximum.
    final: np.ndarray

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = self.final[0] + self.final[1] * np.log1p(total) + self.final[2] * most
        return 1.0 / (1.0 + np.exp(-z))


def _marginals(d: np.ndarray, live: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains (n x t): marginals of label 1, log partition functions, expected moves (2 x 2), those of each chain by its weight."""
    n, t = d.shape
    weight = np.ones(n) if weight is None else weight
    m = np.exp(moves)
    a = np.zeros((t, n, 2))
    norm = np.zeros(n)
    for i in range(t):
        e = np.stack([np.ones(n), np.exp(d[:, i])], 1)
        x = e if i == 0 else (a[i - 1] @ m) * e
        s = x.sum(1)
        on = live[:, i]
        a[i] = np.where(on[:, None], x / s[:, None], a[i - 1] if i else x)
        norm += np.where(on, np.log(s), 0)
    b = np.ones((n, 2))
    out = np.zeros((n, t))
    pairs = np.zeros((2, 2))
    for i in range(t - 1, -1, -1):
        g = a[i] * b
        g /= g.sum(1, keepdims=True)
        out[:, i] = np.where(live[:, i], g[:, 1], 0)
        if i:
            e = np.stack([np.ones(n), np.exp(d[:, i])], 1)
            eb = e * b
            q = a[i - 1][:, :, None] * m[None] * eb[:, None, :]
            q /= q.sum((1, 2), keepdims=True)
            pairs += np.einsum("n,nij->ij", weight * live[:, i], q)
            back = eb @ m.T
            b = np.where(live[:, i][:, None], back / back.sum(1, keepdims=True), b)
    return out, norm, pairs


def windows(bins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's windows: (n x WINDOW x GROUPS) bins and (n x WINDOW) labels, both int8 with -1 after the end, and how many of each there are."""
    n = -(-len(labels) // WINDOW)
    x, y = np.full((n * WINDOW, GROUPS), -1, np.int8), np.full(n * WINDOW, -1, np.int8)
    x[: len(labels)], y[: len(labels)] = bins, labels
    both = np.concatenate([x.reshape(n, -1), y.reshape(n, -1)], 1)
    rows, times = np.unique(both, axis=0, return_counts=True) if n > 1 else (both, np.ones(n, np.int64))
    return rows[:, : WINDOW * GROUPS].reshape(-1, WINDOW, GROUPS), rows[:, WINDOW * GROUPS :], times


def fit_field(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and moves that maximise the conditional likelihood of windows (see `windows`), each as often as its weight says."""
    weight = weight.astype(float)
    w, bias, moves = np.zeros((GROUPS, BINS)), -3.0, np.zeros((2, 2))
    total = max(1.0, float((weight[:, None] * (y >= 0)).sum()))
    seen = np.zeros((2, 2))
    for p in (0, 1):
        for q in (0, 1):
            seen[p, q] = (weight[:, None] * ((y[:, :-1] == p) & (y[:, 1:] == q))).sum()
    size_w, mean, square, step = w.size, np.zeros(w.size + 5), np.zeros(w.size + 5), 0.2
    for r in range(1, rounds + 1):
        grad_w, grad_bias, pairs = np.zeros((GROUPS, BINS)), 0.0, np.zeros((2, 2))
        table = np.concatenate([w, np.zeros((GROUPS, 1))], 1)  # bin -1, after the end, is the last column
        for lo in range(0, len(weight), FIT_ROWS):
            xs, ys, ws = x[lo : lo + FIT_ROWS], y[lo : lo + FIT_ROWS], weight[lo : lo + FIT_ROWS]
            live = ys >= 0
            d = bias + sum(table[g][xs[:, :, g]] for g in range(GROUPS))
            p, _, moved = _marginals(np.where(live, d, 0), live, moves, ws)
            off = np.where(live, (ys - p) * ws[:, None], 0)
            for g in range(GROUPS):
                grad_w[g] += np.bincount(xs[:, :, g][live], off[live], BINS)
            grad_bias += off.sum()
            pairs += moved
        flat = np.concatenate([w.ravel(), [bias], moves.ravel()])
        # A normal prior of variance 1 on every weight, whatever the number of windows.
        grad = (np.concatenate([grad_w.ravel(), [grad_bias], (seen - pairs).ravel()]) - flat) / total * 100
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        flat += step * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
        w, bias, moves = flat[:size_w].reshape(w.shape).copy(), float(flat[size_w]), flat[size_w + 1 :].reshape(2, 2).copy()
        w[:, 0] = 0  # no feature, no weight
    return w, bias, moves


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


class Chain:
    """Exact marginals of long, mostly quiet token chains."""

    def __init__(self, model: Model) -> None:
        self.model = model
        m = np.exp(model.moves)
        quiet = m * np.array([1.0, np.exp(model.bias)])[None, :]
        values, vectors = np.linalg.eig(quiet)
        order = np.argsort(-values.real)
        self.m, self.values, self.vectors = m, values.real[order] / values.real[order][0], vectors.real[:, order]
        self.back = np.linalg.inv(self.vectors)

    def power(self, n: np.ndarray) -> np.ndarray:
        """The quiet transfer matrix to the n-th power, up to a factor."""
        return np.einsum("ij,nj,jk->nik", self.vectors, self.values[None, :] ** n[:, None], self.back)

    def run(self, at: np.ndarray, d: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marginals of label 1 of busy tokens `at` with emission scores d, belonging to `text`."""
        if not len(at):
            return np.zeros(0)
        rows, begin, size = np.unique(text, return_index=True, return_counts=True)
        place = np.arange(len(at)) - np.repeat(begin, size)
        e = np.stack([np.ones(len(at)), np.exp(d)], 1)
        # Quiet tokens before each busy one in its text, and after the last.
        lead = at - np.where(place > 0, np.concatenate(([0], at[:-1])) + 1, first[text])
        tail = first[rows + 1] - 1 - at[begin + size - 1]
        a, b = np.zeros((len(at), 2)), np.ones((len(at), 2))
        order = np.argsort(-size, kind="stable")
        begin, size, tail = begin[order], size[order], tail[order]
        quiet_first = np.array([1.0, np.exp(self.model.bias)])
        for t in range(int(size[0])):
            i = begin[: np.searchsorted(-size, -t, "left")] + t
            gap = lead[i]
            if t == 0:
                # The first token of a chain has an emission but no move into it.
                x = np.where((gap > 0)[:, None], np.einsum("j,njk->nk", quiet_first, self.power(np.maximum(gap - 1, 0))) @ self.m, 1.0)
            else:
                x = np.einsum("nj,njk->nk", a[i - 1], self.power(gap)) @ self.m
            a[i] = _normal(np.abs(x) * e[i])
        last = begin + size - 1
        b[last] = _normal(np.abs(self.power(tail).sum(2)))
        for t in range(int(size[0]) - 1, 0, -1):
            i = begin[: np.searchsorted(-size, -t, "left")] + t
            y = (e[i] * b[i]) @ self.m.T
            b[i - 1] = _normal(np.abs(np.einsum("njk,nk->nj", self.power(lead[i]), y)))
        return _normal(a * b)[:, 1]


def tag(block: tb.Block, chain: Chain) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, float]]]:
    """Of each text the sum and the maximum of its busy tokens' marginals; toxic words as (text, start byte, end byte, marginal)."""
    w = tb.words(block, tb.ALNUM)
    rows = block.hi - block.lo
    bins = emissions(*bins_of(w, chain.model.lexicon), w.first)
    at = np.flatnonzero(bins.any(axis=1))
    text = np.searchsorted(w.first, at, "right") - 1
    d = chain.model.bias + sum(chain.model.weights[g][bins[at, g]] for g in range(GROUPS))
    p = chain.run(at, d, text, w.first)
    total, most = np.bincount(text, p, rows).astype(float), np.zeros(rows)
    np.maximum.at(most, text, p)
    hit = np.flatnonzero(p >= 0.5)
    spans = [(int(text[i]), int(w.starts[at[i]] - block.offsets[text[i]]), int(w.ends[at[i]] - block.offsets[text[i]]), float(p[i])) for i in hit]
    return total, most, spans


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, clean documents) of each block, of texts in column 0 and labels in column 1."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for block in tb.blocks(batch.column(0)):
            w = tb.words(block, tb.ALNUM)
            row = np.repeat(np.arange(block.hi - block.lo), w.counts())
            found, marks = [], []
            for h in features(w):
                order = np.lexsort((row, h))
                x, r = h[order], row[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
                new &= x != 0
                found.append(x[new])
                marks.append(labels[block.lo + r[new]])
            f, place = np.unique(np.concatenate(found), return_inverse=True)
            y = np.concatenate(marks)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *(pa.array(np.bincount(place, y == v, len(f)).astype(np.int64)) for v in (1, 0))], names=["feature", "n1", "n0"])


def _odd_features(rows: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lexicon and their log odds, from rows (text, y) with n1 toxic and n0 clean ones."""
    both = rows.select("text", "y").mapInArrow(_counts, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= MIN_DOCS)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    got = both.select("feature", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS).toArrow()
    names, odds = got.column("feature").to_numpy().astype(np.int64), got.column("odds").to_numpy().astype(float)
    order = np.argsort(names)
    return names[order], odds[order]


def train(labelled: DataFrame, *, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from labelled rows; label is 1 (toxic) or 0, other values are ignored."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(3), key).alias("h"))
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    names, odds = _odd_features(rows, n1, n0)
    model = Model(Lexicon(names.view(np.uint64), np.digitize(odds, EDGES).astype(np.int8)), np.zeros((GROUPS, BINS)), -3.0, np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0]))
    if not len(names):
        return model
    chosen = about(rows.where("y = 1"), F.col("h"), sample, n1).union(about(rows.where("y = 0"), F.col("h"), sample, n0)).select("text", "y")
    # Each task turns whole texts into distinct windows with counts; the driver gets each window once.
    held = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column(0)):
                w = tb.words(block, tb.ALNUM)
                bins = emissions(*bins_of(w, held.value.lexicon), w.first)
                own = np.repeat(labels[block.lo : block.hi], w.counts()) * (np.maximum(bins[:, 0], bins[:, 1]) > 0)
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    x, y, times = windows(bins[a:b], own[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in y], pa.binary()), pa.array(times)], names=["x", "y", "n"])

    got = chosen.mapInArrow(encode, "x binary, y binary, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    x, y = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.int8) for c in ("x", "y"))
    model.weights, model.bias, model.moves = fit_field(x.reshape(-1, WINDOW, GROUPS), y.reshape(-1, WINDOW), got.column("n").to_numpy())
    held.unpersist()
    held.destroy()
    model.final = _fit_final(chosen, model, n1, n0)
    return model


def _fit_final(chosen: DataFrame, model: Model, n1: int, n0: int) -> np.ndarray:
    """The weights of document scores, from (text, y) of the sample: two numbers of each document reach the driver."""
    held = chosen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(held.value)
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                total, most, _ = tag(block, chain)
                yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(most), batch.column(1)[block.lo : block.hi]], names=["total", "most", "y"])

    got = chosen.mapInArrow(run, "total double, most double, y int").toArrow().sort_by([("y", "ascending"), ("total", "ascending"), ("most", "ascending")])
    held.destroy()
    total, most, y = (got.column(c).to_numpy().astype(float) for c in ("total", "most", "y"))
    x = np.stack([np.ones(len(y)), np.log1p(total), most], 1)
    # The sample has as many toxic as clean rows; the labelled rows have not.
    share = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum())) / max(1, n1 + n0)
    b = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        h = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(3)
        b += np.linalg.solve(h, x.T @ (share * (y - q)) - 1e-4 * b)
    return b


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())])


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", with_spans: bool = True) -> tuple[DataFrame, str, str]:
    """docs with a score and the offending spans (code points); the names of both columns."""
    score, spans = free_name(docs, "score"), free_name(docs, "spans")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(spans, T.ArrayType(_SPAN))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(held.value)
        for batch in batches:
            scores, found = [np.zeros(0)], []
            for block in tb.blocks(batch.column(batch.schema.get_field_index(text))):
                total, most, hits = tag(block, chain)
                scores.append(chain.model.score(total, most))
                mine: list[list[dict]] = [[] for _ in range(block.hi - block.lo)]
                if with_spans:
                    by_text: dict[int, list[tuple[int, int, float]]] = {}
                    for r, s, e, p in hits:
                        by_text.setdefault(r, []).append((s, e, p))
                    for r, xs in by_text.items():
                        raw = block.raw[block.offsets[r] : block.offsets[r + 1]]
                        heads = tb.code_points(raw, [v for s, e, _ in xs for v in (s, e)])
                        mine[r] = [{"start": heads[2 * i], "end": heads[2 * i + 1], "marginal": p} for i, (_, _, p) in enumerate(xs)]
                found += mine
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores)), pa.array(found, kind)], names=[*batch.schema.names, score, spans])

    return docs.mapInArrow(run, schema), score, spans


def _held_out(key: str) -> object:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """A model from the labels whose crc32(doc_id as text) mod 3 is not 1, about `labelled` of either label."""
    mine = labels.where(F.col("doc_id").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))
    n1, n0 = mine.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    h = F.xxhash64(F.lit(5), "doc_id")
    some = about(mine.where("toxic = 1"), h, labelled, n1).union(about(mine.where("toxic = 0"), h, labelled, n0))
    # About 2 * labelled rows of 12 bytes: bounded, so texts stay where they are.
    return train(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(cut(some)), "doc_id"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op2."""
    model = trained(docs, labels)
    out, score, spans = score_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), F.col(score).alias("score"), (F.col(score) >= THRESHOLD).cast("int").alias("predicted"), F.size(spans).alias("n_spans"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least the threshold; the model is trained on the labelled ones among them."""
    model = trained(docs, labels)
    out, score, spans = score_documents(docs, model, with_spans=False)
    return out.where(F.col(score) < threshold).drop(score, spans)
