"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad.  Its features are binned measures (letter
case, punctuation, symbols, digits, word lengths, repeated words, repeated
lines) of itself and of the lines before and after; transitions tie
neighbouring labels.  Forward-backward gives each line's marginal probability of
being good; weighted by line length they average to the document's, which a
logistic curve fitted with the field turns into the score.

The field is fitted on a bounded sample: at most ``FIT_DOCS`` labelled documents
in the order of a hash of their id, each line taking its document's label;
documents of more than ``FIT_LINES`` lines stay out of the fit alone.  Scoring
covers every whole text.

Nulls: a null text, an empty one or one of blank lines has no line; its score
is the fitted sample's share of good documents.  Labels that are null or whose
document is absent are not learned from; with no label of either kind every
score is that share (0.5 without any).  Repeated rows are scored each.  Other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import id_remainder
from .storage import in_batches
from .text import CHUNK, U, chunks, mix, string_buffers, words

#: Labelled documents in the fit at most, and lines of each.
FIT_DOCS, FIT_LINES = 3000, 3000
#: Steps of the fit.
STEPS = 80
BINS = 8

_CLASS = np.zeros(256, np.uint8)  # 0: control and blank
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 3
_CLASS[48:58] = 4
for _i, _chars in enumerate((b".", b",;:", b"!?", b"|", b"*#$%&", b"()[]{}<>", b"\"'`", b"-_=+~/\\@^"), 5):
    for _c in _chars:
        _CLASS[_c] = _i
CLASSES = 13
MEASURES = 17


def _line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all lines of the documents, and each line's document; blank lines are left out later."""
    base = offsets[0]
    buf = data[base : offsets[-1]]
    breaks = np.flatnonzero(buf == 10) + 1 + base
    bounds = np.unique(np.concatenate((breaks, offsets)))
    return bounds, np.searchsorted(offsets, bounds[:-1], "right") - 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its document's index, its length in bytes, and its binned measures."""
    bounds, doc = _line_offsets(data, offsets)
    n = len(bounds) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, MEASURES), np.uint8)
    if n <= 0:
        return none
    length = np.diff(bounds)
    line = np.repeat(np.arange(n), length)
    counts = np.bincount(line * CLASSES + _CLASS[data[bounds[0] : bounds[-1]]], minlength=n * CLASSES).reshape(n, CLASSES)
    ids, n_words = words(data, bounds)
    keep = n_words > 0
    if not keep.any():
        return none
    at = np.repeat(np.arange(n), n_words)
    key = np.sort((at.astype(U) << U(36)) | (ids >> U(28)))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    distinct = np.bincount((key[new] >> U(36)).astype(np.int64), minlength=n)
    begin = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(ids, 3))))
    whole = mix(sums[begin + n_words] - sums[begin], 9)
    same = (doc.astype(U) << U(36)) | (whole >> U(28))
    _, back, often = np.unique(same, return_inverse=True, return_counts=True)
    adjacent = np.zeros(len(ids), bool)
    adjacent[1:] = ids[1:] == ids[:-1]
    runs = np.bincount(at[adjacent & np.concatenate(([False], at[1:] == at[:-1]))], minlength=n)
    solid = np.maximum(length - counts[:, 0], 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 3], 1)
    share = lambda x, of: x / of
    w = np.maximum(n_words, 1)
    cols = [share(counts[:, 1], letters), share(counts[:, 3], letters), share(letters, solid)]
    cols += [share(counts[:, c], solid) for c in range(4, CLASSES)]
    ratios = np.stack([*cols, 1 - share(distinct, w), share(runs, w)], 1)  # 14 shares
    binned = np.minimum(np.ceil(np.sqrt(ratios) * (BINS - 1)), BINS - 1).astype(np.uint8)
    others = np.stack([np.minimum(np.log2(1 + n_words), BINS - 1), np.minimum(solid / w / 2, BINS - 1), np.minimum(often[back] - 1, BINS - 1)], 1).astype(np.uint8)
    return doc[keep], length[keep], np.concatenate((binned, others), 1)[keep]


def chain(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each document that has any."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate((first, [len(doc)])))


def _unary(x: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds of good from each line's measures and its neighbours'; w: (3, MEASURES, BINS)."""
    m = np.arange(MEASURES)
    own, before, after = (w[k][m, x].sum(1) for k in range(3))
    starts = np.zeros(len(x), bool)
    starts[first] = True
    u = own
    u[1:] += np.where(starts[1:], 0, before[:-1])
    u[:-1] += np.where(starts[1:], 0, after[1:])
    return u


def forward_backward(u: np.ndarray, first: np.ndarray, size: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of good before and after each line's successors, for all chains at once.

    a: log odds from the line itself and all before it; b: from all after it; a + b: of the marginal.
    t[i, j]: weight of label j after label i.  Also returns the chains' order, longest first.
    """
    order = np.argsort(-size, kind="stable")
    f, s = first[order], size[order]
    a, b = u.copy(), np.zeros(len(u))
    live = np.searchsorted(-s, -np.arange(1, (s[0] if len(s) else 0) + 1), "right")
    for k in range(1, len(live)):
        at = f[: live[k]] + k
        p = a[at - 1]
        a[at] += np.logaddexp(t[0, 1], t[1, 1] + p) - np.logaddexp(t[0, 0], t[1, 0] + p)
    for k in range(len(live) - 1, 0, -1):
        at = f[: live[k]] + k
        q = u[at] + b[at]
        b[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + q) - np.logaddexp(t[0, 0], t[0, 1] + q)
    return a, b, order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Field:
    w: np.ndarray
    t: np.ndarray
    slope: float
    level: float
    prior: float

    def documents(self, doc: np.ndarray, length: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Score of each of n documents from its lines."""
        out = np.full(n, self.prior)
        first, size = chain(doc)
        if len(doc) and self.w.any():
            a, b, _ = forward_backward(_unary(x, first, self.w), first, size, self.t)
            good = np.add.reduceat(_sigmoid(a + b) * length, first) / np.add.reduceat(length, first)
            good = np.clip(good, 1e-4, 1 - 1e-4)
            out[doc[first]] = _sigmoid(self.slope * np.log(good / (1 - good)) + self.level)
        return out


def fit(doc: np.ndarray, length: np.ndarray, x: np.ndarray, label: np.ndarray, steps: int = STEPS, ridge: float = 2.0) -> Field:
    """A field from lines of documents and each document's label, by gradient ascent on the conditional likelihood.

    Both labels' documents weigh the same in all, and a line no more in a long document than in a short one.
    """
    first, size = chain(doc)
    y_doc = label[doc[first]].astype(float) if len(doc) else np.zeros(0)
    prior = float(label.mean()) if len(label) else 0.5
    w, t = np.zeros((3, MEASURES, BINS)), np.zeros((2, 2))
    if not len(doc) or y_doc.min() == y_doc.max():
        return Field(w, t, 1.0, 0.0, prior)
    y = np.repeat(y_doc, size)
    each = np.where(y_doc > 0, 0.5 / y_doc.sum(), 0.5 / (1 - y_doc).sum()) * len(first)
    weight = np.repeat(each / np.sqrt(size), size)
    m = np.arange(MEASURES)
    flat = (m * BINS + x).astype(np.int64)
    starts = np.zeros(len(x), bool)
    starts[first] = True
    inner = np.flatnonzero(~starts)  # lines with one before them
    step = {"w": np.full(w.shape, 0.05), "t": np.full(t.shape, 0.05)}
    was = {"w": np.zeros(w.shape), "t": np.zeros(t.shape)}
    for _ in range(steps):
        a, b, _ = forward_backward(_unary(x, first, w), first, size, t)
        p = _sigmoid(a + b)
        r = (y - p) * weight
        g = np.empty(w.shape)
        for k, (lines, signal) in enumerate(((slice(None), r), (inner - 1, r[inner]), (inner, r[inner - 1]))):
            g[k] = np.bincount(flat[lines].ravel(), np.repeat(signal, MEASURES), minlength=MEASURES * BINS).reshape(MEASURES, BINS)
        g -= ridge * w
        # Pairs of labels: expected less observed.
        u = _unary(x, first, w)
        before, here = a[inner - 1], u[inner] + b[inner]
        score = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] + here, t[1, 0] + before, t[1, 1] + before + here])
        score = np.exp(score - score.max(0))
        score /= score.sum(0)
        seen = np.stack([(1 - y[inner - 1]) * (1 - y[inner]), (1 - y[inner - 1]) * y[inner], y[inner - 1] * (1 - y[inner]), y[inner - 1] * y[inner]])
        gt = ((seen - score) * weight[inner]).sum(1).reshape(2, 2) - ridge * 20 * t
        for name, value, grad in (("w", w, g), ("t", t, gt)):  # resilient steps: by the gradient's sign
            turn = np.sign(grad) * was[name]
            step[name] = np.clip(np.where(turn > 0, step[name] * 1.2, np.where(turn < 0, step[name] * 0.5, step[name])), 1e-6, 0.5)
            move = np.where(turn < 0, 0, np.sign(grad))
            value += move * step[name]
            was[name] = move
    a, b, _ = forward_backward(_unary(x, first, w), first, size, t)
    good = np.clip(np.add.reduceat(_sigmoid(a + b) * length, first) / np.add.reduceat(length, first), 1e-4, 1 - 1e-4)
    z = np.log(good / (1 - good))
    slope, level = 1.0, 0.0
    for _ in range(50):  # Newton's method for the curve, slightly damped
        q = _sigmoid(slope * z + level)
        v = q * (1 - q) + 1e-6
        grad = np.array([((y_doc - q) * z).sum() - 0.5 * (slope - 1), (y_doc - q).sum()])
        hess = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum()]])
        d = np.linalg.solve(hess, grad)
        slope, level = slope + float(np.clip(d[0], -1, 1)), level + float(np.clip(d[1], -2, 2))
    return Field(w, t, slope, level, prior)


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, length, measures) of each sampled document, lines packed."""
    for b in batches:
        data, offsets = string_buffers(b.column(1))
        for i, j in chunks(offsets):
            doc, length, x = line_features(data, offsets[i : j + 1])
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            keep = [k for k in range(j - i) if cut[k + 1] - cut[k] <= FIT_LINES]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i).take(pa.array(keep, pa.int64())), pa.array([length[cut[k] : cut[k + 1]].astype(np.int64).tobytes() for k in keep], pa.binary()), pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in keep], pa.binary())],
                ["label", "length", "x"],
            )


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = FIT_DOCS) -> Field:
    """Fit on at most ``most`` documents of ``docs(doc_id, text)`` that ``labels(doc_id, label_col)`` marks."""
    marked = labels.select(F.col("doc_id").cast("long").alias("of"), F.col(label_col).cast("int").alias("label")).where("of is not null and label is not null").groupBy("of").agg(F.max("label").alias("label"))
    chosen = marked.orderBy(F.xxhash64("of"), "of").limit(most)
    own = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("of", "label", F.col("text").cast("string").alias("text"))
    rows = own.groupBy("of").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")  # one of the texts of a repeated id
    got = in_batches(rows, _sample_lines, "label int, length binary, x binary").toPandas().sort_values(["label", "x", "length"], kind="stable")
    lengths = [np.frombuffer(v, np.int64) for v in got["length"]]
    doc = np.repeat(np.arange(len(got)), [len(v) for v in lengths])
    length = np.concatenate([*lengths, np.zeros(0, np.int64)])
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, MEASURES)
    return fit(doc, length, x, got["label"].to_numpy(np.int64))


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType(list(docs.schema.fields)).add("score", "double")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_buffers(b.column(at))
            said = [sent.value.documents(*line_features(data, offsets[i : j + 1]), j - i) for i, j in chunks(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*said, np.zeros(0)]))], schema.names)

    return in_batches(docs, run, schema)


THRESHOLD = 0.3


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); fitted on rows whose id's remainder modulo 5 is not 0."""
    seen = id_remainder(F.col("doc_id"), 5) != 0
    field = learn(docs.where(seen).select("doc_id", "text"), labels.where(seen))
    rows = docs.select("doc_id", (~seen).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, field).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
