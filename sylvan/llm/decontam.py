"""Benchmark decontamination by latent semantic retrieval.

1.  One pass over all documents counts in how many each hashed term occurs and
    writes every document's terms with their counts.
2.  A randomised SVD of the TF-IDF rows of all benchmark passages and all
    documents, distributed over the rows' partitions (range finder with power
    iterations; only terms x (rank + oversampling) matrices meet), gives the
    latent space.
3.  Every document is cut into windows of ``WINDOWS`` cells of ``CELL`` words;
    windows and benchmark passages whose latent product over their TF-IDF norms
    reaches ``MIN_COSINE`` are candidates.  So is text that shares enough word
    pairs with a passage (see ``pair_index``), whatever the benchmark's size:
    what 128 dimensions keep of a passage falls as items are added.
4.  A candidate stands if the longest common subsequence of words covers
    ``MIN_COVER`` of the benchmark item and ``MIN_ANSWER`` of its answer (its
    last ``ANSWER`` words), or ``VERBATIM`` of the item alone.

Words are those of the lower-cased text.  The benchmark is sent to all tasks in
blocks of at most ``ITEMS`` items and ``ITEM_WORDS`` words, one pass over the
documents a block; the index covers every window of every document.

Nulls: a null or wordless text matches nothing; items that are null or of fewer
than ``MIN_WORDS`` words are not searched.  A null doc_id stays null in the
pairs.  Repeated rows and repeated items give repeated pairs.  Ties do not
matter: every pair that stands is returned.  Other columns are ignored.  Either
table empty: no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import collect_garbage, drop, in_batches, materialise
from .text import U, string_buffers, token_hash, word_batches

#: Hashed terms; latent dimensions and oversampling; power iterations.
TERMS, RANK, EXTRA, POWERS = 1 << 14, 128, 16, 2
#: Weight of a benchmark passage in the decomposition; all documents together weigh as so many rows of weight 1 at most, however many they are.
BENCH_WEIGHT, DOCS_WEIGHT = 4.0, 4096
CELL, WINDOWS = 12, (2, 3, 5)
#: Words of a benchmark passage; a longer item is searched by several.
PASSAGE = 48
MIN_COSINE, MIN_COVER, MIN_ANSWER, VERBATIM = 0.32, 0.6, 0.5, 0.8
ANSWER, MIN_WORDS = 8, 5
ITEMS, ITEM_WORDS = 20_000, 2_000_000
#: Words from the first to the second of a word pair at most, in an item and in a text; pairs with their items held at once.
ITEM_GAP, TEXT_GAP, HITS = 2, 3, 200_000
_CHUNK = 1024
#: Tasks that multiply rows at most; each adds a matrix of terms x (rank + oversampling).
PARTS = 128
#: Rows that are multiplied together.
ROWS = 256
#: Occurrences that one entry of a document's terms stands for at most.
MOST = 1 << 17


def _terms(ids: np.ndarray) -> np.ndarray:
    return (ids & U(TERMS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ("row", 0, 0, a document's terms) and ("df", chunk, documents, counts of the chunk's terms)."""
    df, n = np.zeros(TERMS, np.int64), 0
    names, chunks = ["kind", "chunk", "n", "data"], TERMS // _CHUNK
    for b in batches:
        for _, ids, counts in word_batches(b.column(0)):
            doc = np.repeat(np.arange(len(counts)), counts)
            key, often = np.unique(doc * TERMS + _terms(ids), return_counts=True)
            df += np.bincount(key % TERMS, minlength=TERMS)
            worded = np.flatnonzero(counts)
            n += len(worded)
            entries = -(-often // MOST)
            key, often = np.repeat(key, entries), np.repeat(often - (entries - 1) * MOST, entries)
            often[np.concatenate((key[1:] == key[:-1], [False]))[: len(key)]] = MOST
            # An entry's low bits are the term, the others how many more times it occurs.
            packed = (key % TERMS | (often - 1) * TERMS).astype(np.int32)
            ends = np.searchsorted(key, (worded + 1) * TERMS) * 4
            data = pa.Array.from_buffers(pa.binary(), len(worded), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(["row"] * len(worded), pa.string()), pa.array([0] * len(worded), pa.int32()), pa.array([0] * len(worded), pa.int64()), data], names)
    sums = [df[c * _CHUNK : (c + 1) * _CHUNK].tobytes() for c in range(chunks)]
    yield pa.RecordBatch.from_arrays([pa.array(["df"] * chunks, pa.string()), pa.array(range(chunks), pa.int32()), pa.array([n] * chunks, pa.int64()), pa.array(sums, pa.binary())], names)


def _sum(kind: type):
    """Sums of the arrays of a chunk."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), kind).astype(np.float64) for x in table["data"])
        n = sum(x.as_py() or 0 for x in table["n"])
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    return run


def _gather(rows: DataFrame, kind: type) -> tuple[np.ndarray, int]:
    """The sums of all chunks, in order; of bounded size."""
    got = rows.groupBy("chunk").applyInArrow(_sum(kind), "chunk int, n long, data binary").collect()
    got.sort(key=lambda r: r["chunk"])
    collect_garbage(rows.sparkSession)
    return np.concatenate([np.frombuffer(r["data"], np.float64) for r in got] or [np.zeros(0)]), got[0]["n"] if got else 0


def _matrix(b: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of unit length times their weight: row, term and value, in order of the rows."""
    data, offsets = string_buffers(b.column(1))
    entries = data[offsets[0] : offsets[-1]].view(np.int32)
    key = np.repeat(np.arange(len(b)), np.diff(offsets) // 4) * TERMS + entries % TERMS
    often = (entries // TERMS + 1).astype(np.float64)
    if (key[1:] <= key[:-1]).any():
        key, own = np.unique(key, return_inverse=True)
        often = np.bincount(own, often)
    row, term = key // TERMS, key % TERMS
    v = often * idf[term]
    norm = np.sqrt(np.bincount(row, v * v, len(b)))
    return row, term, (b.column(0).to_numpy()[row] * v / np.maximum(norm, 1e-9)[row]).astype(np.float32)


def _step(m: np.ndarray, idf: np.ndarray):
    """Partial sums of A'(A m), by chunks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m.shape, np.float32)
        for b in batches:
            row, term, value = _matrix(b, idf)
            for a in range(0, len(b), ROWS):
                i, j = np.searchsorted(row, (a, a + ROWS))
                terms, at = np.unique(term[i:j], return_inverse=True)
                block = np.zeros((ROWS, len(terms)), np.float32)  # without the terms that none of its rows has
                block[row[i:j] - a, at] = value[i:j]
                total[terms] += block.T @ (block @ m[terms])
        parts = np.split(total, TERMS // _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([0] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "n", "data"])

    return run


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (terms x rank, fewer if A has not so many) of the TF-IDF matrix A of ``rows(weight, terms)``."""
    q = np.random.default_rng(seed).standard_normal((TERMS, rank + EXTRA))
    for _ in range(POWERS):
        q, _ = np.linalg.qr(q)
        y, _ = _gather(in_batches(rows, _step(q.astype(np.float32), idf), "chunk int, n long, data binary"), np.float32)
        basis, q = q, y.reshape(q.shape) if len(y) else np.zeros(q.shape)
    # A'A is y (q'y)^-1 y' on what q spans: its factor's singular values are the squares' roots.
    g = basis.T @ q
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    sure = values > 1e-5 * max(values[-1], 1e-9)
    u, s, _ = np.linalg.svd(q @ (vectors[:, sure] / np.sqrt(values[sure])), full_matrices=False)
    return s[:rank], u[:, :rank]


@dataclass(frozen=True)
class Index:
    """A block of benchmark items with their latent passages, and the space they are in."""

    ids: list[int]
    words: list[np.ndarray]
    space: np.ndarray  # terms x rank, by the terms' weights
    square: np.ndarray  # the terms' weights squared
    passages: np.ndarray  # passages x rank, over their TF-IDF norms
    of: np.ndarray  # the item of each passage
    vocabulary: np.ndarray  # the items' words, in order
    maybe: np.ndarray  # whether any of them has these low bits
    pairs: PairIndex

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Places of the words that an item has."""
        return _places(self.vocabulary, self.maybe, ids)[0]


@dataclass(frozen=True)
class PairIndex:
    """Word pairs of the passages that are looked up."""

    keys: np.ndarray  # in order
    maybe: np.ndarray  # whether any of them has these low bits
    first: np.ndarray  # where the passages of each key begin
    passage: np.ndarray
    need: np.ndarray  # pairs that a passage must share
    size: np.ndarray  # words of a passage


def _maybe(keys: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << max(16, (8 * len(keys)).bit_length()), bool)
    maybe[(keys & U(len(maybe) - 1)).astype(np.int64)] = True
    return maybe


def _places(keys: np.ndarray, maybe: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ids that are among the sorted keys, and which keys they are."""
    at = np.flatnonzero(maybe[(ids & U(len(maybe) - 1)).astype(np.int64)])
    near = np.minimum(np.searchsorted(keys, ids[at]), len(keys) - 1)
    same = keys[near] == ids[at]
    return at[same], near[same]


def _pairs(ids: np.ndarray, gap: int) -> np.ndarray:
    """Keys of the ordered pairs of words that are ``gap`` words apart, by their first."""
    return ids[:-gap] * U(0xD6E8FEB86659FD93) + ids[gap:]


def pair_index(passages: list[np.ndarray]) -> PairIndex:
    """Pairs of which any copy that can stand has a passage's ``need``.

    A subsequence of m of a passage's n words has m - 1 pairs of neighbours, of which at most (n - m) / 2 are more than
    two words apart in the passage.  So a copy with replaced and left-out words has m - 1 - (n - m) // 2 pairs with
    gaps of up to two words; half of them are asked for, for the sake of words put in, of which it takes three to part
    a pair.  As many pairs as are not asked for, those that the most passages have, are not looked up.  If an item is
    covered, one of its passages is.
    """
    every = [np.unique(np.concatenate([_pairs(p, g) for g in range(1, ITEM_GAP + 1)]), return_counts=True) for p in passages]
    size = np.array([len(p) for p in passages], np.int64)
    m = np.ceil(MIN_COVER * size - 1e-9).astype(np.int64)
    sure = np.maximum(m - 1 - (size - m) // 2, 1)
    need = (sure + 1) // 2
    keys, held = np.unique(np.concatenate([k for k, _ in every]), return_counts=True)
    of, used = [], []
    for i, (k, n) in enumerate(every):
        at = np.searchsorted(keys, k)
        common = np.argsort(-held[at], kind="stable")
        kept = at[common[np.cumsum(n[common]) > sure[i] - need[i]]]
        used.append(kept)
        of.append(np.full(len(kept), i))
    at, passage = np.concatenate(used), np.concatenate(of)
    order = np.argsort(at, kind="stable")
    own, n = np.unique(at, return_counts=True)
    return PairIndex(keys[own], _maybe(keys[own]), np.concatenate(([0], np.cumsum(n))), passage[order], need, size)


def _lexical(ix: Index, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, float | None]]:
    """(document, item, first and last word, None) of stretches that share enough pairs with a passage."""
    px = ix.pairs
    start = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), counts)
    found = []
    for gap in range(1, TEXT_GAP + 1):
        at, key = _places(px.keys, px.maybe, _pairs(ids, gap))
        same = doc[at] == doc[at + gap]
        found.append((at[same], key[same]))
    at, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    at, key = at[order], key[order]
    n = px.first[key + 1] - px.first[key]
    total = np.cumsum(n)
    b = 0
    while b < len(at):
        # Parts overlap by the longest stretch.
        a, b = int(np.searchsorted(at, at[b] - 2 * PASSAGE)), max(b + 1, int(np.searchsorted(total, total[b] + HITS)))
        own = np.repeat(np.arange(a, min(b, len(at))), n[a:b])
        p = px.passage[px.first[key[own]] + np.arange(len(own)) - np.repeat(total[a:b] - n[a:b] - total[a] + n[a], n[a:b])]
        q = at[own]
        by = np.argsort(p, kind="stable")
        p, q = p[by], q[by]
        last = np.arange(len(p)) + px.need[p] - 1
        i = np.flatnonzero(last < len(p))
        j = last[i]
        near = (p[i] == p[j]) & (doc[q[i]] == doc[q[j]]) & (q[j] - q[i] <= 2 * px.size[p[i]])
        i, j = i[near], j[near]
        if not len(i):
            continue
        # Stretches of a document and passage that overlap are one.
        new = np.flatnonzero(np.concatenate(([True], (p[i[1:]] != p[i[:-1]]) | (doc[q[i[1:]]] != doc[q[i[:-1]]]) | (q[i[1:]] > q[j[:-1]]))))
        i, j = i[new], j[np.concatenate((new[1:], [len(j)])) - 1]
        d = doc[q[i]]
        yield from zip(d.tolist(), ix.of[p[i]].tolist(), (q[i] - start[d]).tolist(), np.minimum(q[j] - start[d] + TEXT_GAP + 1, counts[d]).tolist(), [None] * len(i), strict=True)


def _cosine(ix: Index, item: int, words: np.ndarray) -> float:
    """The largest latent product of the words and a passage of the item, over their norms."""
    t = _terms(words)
    v = ix.space[t[ix.known(words)]].sum(0) / max(np.sqrt(ix.square[t].sum()), 1e-6)
    return float((ix.passages[ix.of == item] @ v).max())


def item_passages(words: np.ndarray) -> list[np.ndarray]:
    n = max(1, -(-len(words) // PASSAGE))
    return np.array_split(words, n)


def index(ids: list[int], words: list[np.ndarray], space: np.ndarray, idf: np.ndarray) -> Index:
    of, rows, passages = [], [], []
    for i, w in enumerate(words):
        for p in item_passages(w):
            passages.append(p)
            t = _terms(p)
            of.append(i)
            rows.append(idf[t] @ space[t] / max(np.sqrt((idf[t] ** 2).sum()), 1e-9))
    vocabulary = np.unique(np.concatenate(words))
    return Index(ids, words, (space * idf[:, None]).astype(np.float32), (idf * idf).astype(np.float32), np.array(rows, np.float32).reshape(len(of), space.shape[1]), np.array(of, np.int64), vocabulary, _maybe(vocabulary), pair_index(passages))


def common(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, by bit vectors."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = places.get(w)
        if m:
            x = v & m
            v = ((v + x) | (v - x)) & full
    return len(item) - v.bit_count()


def _windows(ix: Index, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, first and last word, cosine) of candidate windows."""
    if not len(ids):
        return
    n_cells = -(-counts // CELL)
    cell_of_doc = np.concatenate(([0], np.cumsum(n_cells)))
    start = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), n_cells)
    first = start[doc] + (np.arange(len(doc)) - cell_of_doc[doc]) * CELL
    t = _terms(ids)
    known = ix.known(ids)  # other words meet none of an item's, so they weigh in the norm alone
    vectors = np.zeros((len(doc), ix.space.shape[1]), np.float32)
    cell = np.searchsorted(first, known, "right") - 1
    new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(known) else known
    rank = np.arange(len(known)) - np.repeat(new, np.diff(np.concatenate((new, [len(known)]))))
    for k in range(CELL):  # the k-th known word of each cell
        sel = np.flatnonzero(rank == k)
        vectors[cell[sel]] += ix.space[t[known[sel]]]
    weight = np.add.reduceat(ix.square[t].astype(np.float64), first)
    norms = np.concatenate(([0], np.cumsum(weight)))
    at = np.arange(len(doc))
    ends = [np.minimum(at + w, cell_of_doc[doc + 1]) for w in WINDOWS]
    sizes = [np.sqrt(np.maximum(norms[e] - norms[at], 1e-12)).astype(np.float32) for e in ends]
    for p in range(0, len(ix.passages), 256):
        # A window's product with a passage is the sum of its cells'.
        own = vectors @ ix.passages[p : p + 256].T
        sums = np.concatenate((np.zeros((1, own.shape[1]), np.float32), np.cumsum(own, 0)))
        for w, end, size in zip(WINDOWS, ends, sizes, strict=True):
            c = sums[end]
            c -= sums[:-1]
            k, j = np.nonzero(c >= MIN_COSINE * size[:, None])
            d = doc[k]
            start_in = first[k] - start[d]
            yield from zip(d.tolist(), ix.of[p + j].tolist(), start_in.tolist(), np.minimum(start_in + w * CELL, counts[d]).tolist(), (c[k, j] / size[k]).tolist(), strict=True)


def matches(ix: Index, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """(document, item, cosine, cover, answer's cover) of the pairs that stand."""
    start = np.concatenate(([0], np.cumsum(counts)))
    found: dict[tuple[int, int], list[tuple[int, int, float | None]]] = {}
    for d, item, a, b, c in chain(_windows(ix, ids, counts), _lexical(ix, ids, counts)):
        found.setdefault((d, item), []).append((a, b, c))
    for (d, item), spans in found.items():
        w = ix.words[item]
        best = (False, 0.0, 0.0)
        reach, last = -1, None
        # Windows that overlap are read once, with the item's length of text on both sides.
        for a, b, _ in [*sorted(spans, key=lambda s: s[:2]), (1 << 62, 0, 0)]:
            if a <= reach:
                reach = max(reach, b)
                continue
            if last is not None:
                text = ids[start[d] + max(0, last - len(w)) : start[d] + min(reach + len(w), int(counts[d]))]
                near = set(text.tolist())
                if sum(x in near for x in w.tolist()) < MIN_COVER * len(w):  # no subsequence can cover enough
                    last, reach = a, b
                    continue
                cover = common(w, text) / len(w)
                if cover >= MIN_COVER:
                    tail = w[-ANSWER:]
                    answer = common(tail, text) / len(tail)
                    best = max(best, (cover >= VERBATIM or answer >= MIN_ANSWER, cover, answer))
            last, reach = a, b
        if best[0]:
            yield d, item, max(_cosine(ix, item, ids[start[d] + a : start[d] + b]) if c is None else c for a, b, c in spans), *best[1:]


PAIRS = "doc_id long, item_id long, cosine double, cover double, answer_cover double"


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            rows = []
            for i, ids, counts in word_batches(b.column(1)):
                rows += [(i + d, ix.ids[item], c, cover, answer) for d, item, c, cover, answer in matches(ix, ids, counts)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4))], [f.split()[0] for f in PAIRS.split(", ")])

    return run


def _item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items and their words in blocks of bounded size, streamed from their partitions."""
    ids, words, n = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        w = token_hash(r["text"])
        if len(w) < MIN_WORDS:
            continue
        ids.append(r["id"])
        words.append(w)
        n += len(w)
        if len(ids) >= ITEMS or n >= ITEM_WORDS:
            yield ids, words
            ids, words, n = [], [], 0
    if ids:
        yield ids, words


def _bench_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_terms(p).astype(np.int32).tobytes() for t in b.column(0).to_pylist() if t for w in [token_hash(t)] if len(w) >= MIN_WORDS for p in item_passages(w)]
        yield pa.RecordBatch.from_arrays([pa.array([BENCH_WEIGHT] * len(out), pa.float64()), pa.array(out, pa.binary())], ["weight", "terms"])


def latent_space(docs: DataFrame, benchmark: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The terms' weights and the latent space, both from all documents."""
    counted = materialise(in_batches(docs.select(F.col("text").cast("string")), _count, "kind string, chunk int, n long, data binary"), "terms")
    df, n = _gather(counted.where("kind = 'df'").select("chunk", "n", "data"), np.int64)
    df = df if len(df) else np.zeros(TERMS)
    idf = np.log((n + 1.5) / (df + 0.5)).clip(0.01)
    every = counted.where("kind = 'row'").select(F.lit(min(1.0, (DOCS_WEIGHT / max(n, 1)) ** 0.5)).alias("weight"), F.col("data").alias("terms"))
    own = materialise(in_batches(benchmark.select(F.col("text").cast("string")), _bench_terms, "weight double, terms binary"), "passages")
    _, space = randomised_svd(every.unionByName(own).coalesce(PARTS), idf)
    for used in (counted, own):
        drop(used)
    return idf, space


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, cover, answer_cover) of every pair that stands."""
    spark: SparkSession = docs.sparkSession
    idf, space = latent_space(docs, benchmark)
    out = None
    for ids, words in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(index(ids, words, space, idf))
        found = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _search(sent), PAIRS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item stands; decided row by row, where each text is read."""
    spark: SparkSession = docs.sparkSession
    idf, space = latent_space(docs, benchmark)
    at = docs.columns.index("text")
    for ids, words in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(index(ids, words, space, idf))
        docs = in_batches(docs, _filter(sent, at), docs.schema)
    return docs


def _filter(sent, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(len(b), bool)
            for i, ids, counts in word_batches(b.column(at)):
                keep[[i + m[0] for m in matches(sent.value, ids, counts)]] = False
            yield b.filter(pa.array(keep))

    return run
