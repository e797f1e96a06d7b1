"""N-gram language model in sharded Elias-Fano tries, and scores of whole texts.

Texts are tokenised once into blocks of about ``BLOCK`` tokens, kept in the
shared folder and bucketed by block.  For each order k from 1 up, a block sends
each distinct (context, word) once to the shard of that context with its
training count; the shard adds the counts of all blocks, builds a trie
(contexts, pointers, successors, running counts, quantised smoothed
probabilities; memory-mapped, see elias_fano) and answers every block by
context-relative successor search.  So the model covers every training token,
grows with the corpus, and no task holds more than one block or one shard.

A context that occurs more than ``HOT`` times is split over shards by the word
that follows, so neither a frequent word nor a repeated passage fills a shard;
its count is known from the order below, so no shard needs the whole context.

Order 1 is the base, log10((c + 0.5) / (N + 0.5 (V + 1))).  Order k smooths with
the order below: (c(h w) + mu P(w | shorter h)) / (c(h) + mu), which sums to one
over the vocabulary and gives the lower order where h was never seen.  In the
tries log10 P is kept in 16 bits (steps of 1/2048).

Tokens: words of the lower-cased (A-Z) text and one end token; contexts reach
back to the text's start, marked as such.  Words are 64-bit hashes; contexts 56
bits and successors within a context 32 bits of them.

Nulls: a null text is an empty one: its only token is the end.  A null id hashes
as the empty text and counts as training.  Without training rows all counts are
0 and each token's base is that of an unseen word.  Repeated rows count and are
scored each.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import Trie
from .langid import id_remainder
from .storage import collect_garbage, in_batches, materialise, new_path
from .text import U, mix, word_batches

#: Tokens in a block, about; records (distinct n-grams of a block) in a shard, about.
BLOCK, SHARD = 640_000, 500_000
#: Occurrences beyond which a context's successors are dealt over several shards.
HOT = 200_000
#: Weight of the order below.
MU = 30.0
ORDER = 2
STEP = 2048.0

_END, _BOS = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    kind = {1: b"B", 2: b"H", 4: b"I", 8: b"Q"}[a.itemsize]
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return kind + struct.pack("<q", len(a)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = {66: np.uint8, 72: np.uint16, 73: np.uint32, 81: np.uint64}[data[0]]
    n = struct.unpack_from("<q", data, 1)[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * np.dtype(kind).itemsize)), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(-1)


def join(parts: list[np.ndarray]) -> bytes:
    packed = [pack(p) for p in parts]
    return struct.pack(f"<{len(packed) + 1}q", len(packed), *map(len, packed)) + b"".join(packed)


def split(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<q", data)[0]
    sizes = struct.unpack_from(f"<{n}q", data, 8)
    at, out = 8 * (n + 1), []
    for s in sizes:
        out.append(unpack(data[at : at + s]))
        at += s
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the values."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, held, text) to blocks."""
    ids: list[list] = [[], []]
    sizes: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    have, made = 0, 0
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def flush() -> pa.RecordBatch:
        nonlocal have, made, ids, sizes, hashes
        words, at, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int64)
        order = np.argsort(-often, kind="stable")
        rank[order] = np.arange(len(words))
        row = pa.RecordBatch.from_arrays(
            [pa.array([first + made]), pa.array([ids[0]], pa.list_(pa.int64())), pa.array([ids[1]], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([pack(words[order])], pa.binary()), pa.array([pack(narrow(rank[at]))], pa.binary())],
            [f.split()[0] for f in BLOCK_SCHEMA.split(", ")],
        )
        ids, sizes, hashes, have, made = [[], []], [], [], 0, made + 1
        return row

    for b in batches:
        who, held = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, h, counts in word_batches(b.column(2)):
            cut = np.cumsum(counts)
            hashes.append(np.insert(h, cut, _END))
            sizes.append((counts + 1).astype(np.int32))
            ids[0] += who[i : i + len(counts)]
            ids[1] += held[i : i + len(counts)]
            have += len(h) + len(counts)
            if have >= BLOCK:
                yield flush()
    if have:
        yield flush()


def _quantise(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logp * STEP), 0, 65535).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -STEP


class Replay:
    """One block's tokens, their n-grams of each order, and what the shards have answered.

    Words are places in the block's vocabulary in order of their hashes, so
    n-grams sorted by places are sorted by contexts and words as shards know them.
    """

    def __init__(self, row: dict, stats: dict) -> None:
        self.ids, self.held, self.stats = row["ids"], np.array(row["held"], bool), stats
        self.sizes = np.array(row["sizes"], np.int64)
        words, tokens = unpack(row["words"]), unpack(row["tokens"])
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.w = words[order], rank[tokens].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.train = ~np.repeat(self.held, self.sizes)
        self.order = 0
        self.hash = np.zeros(1, U)  # of each context
        self.which = np.zeros(len(self.w), np.int64)  # the context of each token

    def _contexts(self) -> np.ndarray:
        """Contexts of the next order and how often each occurs in training; called after take()."""
        shifted = np.empty(len(self.w), np.int32)
        shifted[1:] = self.at[:-1]
        shifted[self.first] = len(self.one)  # the text's start
        self.hash = np.concatenate((self.words if self.order == 1 else mix(self.hash[self.of_ctx] * U(3) + self.words[self.of_word], 20 + self.order), [_BOS]))
        order = np.argsort(self.hash)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hash, self.which = self.hash[order], rank[shifted].astype(np.int32)
        return np.concatenate((self.count, [self.stats["docs"]]))[order]

    def grams(self) -> None:
        """Distinct n-grams of the next order, in the order in which they are sent."""
        v, n_shards = len(self.words), self.stats["shards"]
        if not self.order:
            self.order, self.at = 1, self.w
            self.one, self.of_word, self.of_ctx = np.arange(v), np.arange(v), np.zeros(v, np.int64)
            ctx, succ, of = self.words >> U(8), (self.words & U(0xFFFFFFFF)).astype(np.uint32), np.zeros(v, np.int64)
            self.lower = np.zeros(v)
        else:
            total = self._contexts()
            self.order += 1
            key, at = np.unique(self.which.astype(np.int64) * v + self.w, return_inverse=True)
            self.at = at.astype(np.int32)
            self.of_ctx, self.of_word = np.divmod(key, v)
            self.one = key
            lower = np.empty(len(key))
            lower[self.at] = self.logp
            self.lower = lower
            ctx, succ, of = self.hash[self.of_ctx] >> U(8), (self.words[self.of_word] >> U(32)).astype(np.uint32), total[self.of_ctx]
        self.of = of
        train = np.bincount(self.at[self.train], minlength=len(ctx))
        # Shards are ranges of contexts, so what is sorted stays so; a hot context's words go elsewhere.
        shard = ((ctx >> U(24)) * U(n_shards) >> U(32)).astype(np.int64)
        hot = np.flatnonzero(of >= HOT)
        if len(hot):
            salt = succ[hot].astype(U) % (of[hot] // HOT + 1).astype(U)
            shard[hot] = (mix(ctx[hot] + salt * U(0xD6E8FEB86659FD93), 31) % U(n_shards)).astype(np.int64)
        self.by = np.argsort(shard.astype(np.uint16) if n_shards < 2**16 else shard, kind="stable")
        by = self.by
        self.sent = ctx[by], succ[by], train[by], _quantise(self.lower)[by], of[by]
        self.cuts = np.searchsorted(shard[by], np.arange(n_shards + 1))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        ctx, succ, train, lower, of = self.sent
        del self.sent
        for s in range(len(self.cuts) - 1):
            i, j = self.cuts[s], self.cuts[s + 1]
            if i == j:
                continue
            c = ctx[i:j]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            delta = np.diff(np.concatenate((np.zeros(1, U), c[first])))
            runs = np.diff(np.concatenate((first, [j - i])))
            parts = [delta, narrow(runs), succ[i:j], narrow(train[i:j])]
            yield s, join(parts if self.order == 1 else [*parts, lower[i:j], narrow(of[i:j][first])])

    def take(self, answers: list[dict]) -> None:
        """Use the shards' answers to the grams sent."""
        n = len(self.by)
        count, code = np.zeros(n, np.int64), np.zeros(n, np.uint16)
        for a in answers:
            i, j = self.cuts[a["shard"]], self.cuts[a["shard"] + 1]
            got = split(a["data"])
            count[i:j], code[i:j] = got[0], got[1] if self.order > 1 else 0
        c = np.empty(n, np.int64)
        c[self.by] = count
        if self.order == 1:
            n_tokens, vocabulary = self.stats["tokens"], self.stats["vocabulary"]
            logp = np.log10((c + 0.5) / (n_tokens + 0.5 * (vocabulary + 1)))
            self.base, self.known = logp[self.at], (c > 0)[self.at]
        else:
            value = np.empty(n)
            value[self.by] = _value(code)
            logp = np.where(c > 0, value, self.lower + np.log10(MU / (self.of + MU)))
        self.logp, self.count = logp[self.at], c

    def documents(self) -> list[np.ndarray]:
        add = lambda x: np.add.reduceat(x, self.first)
        return [self.sizes, add(self.known.astype(np.int64)), add(self.base), add(self.logp)]


def _replayed(row: dict, stats: dict, orders: int) -> Replay:
    r = Replay(row, stats)
    for k in range(1, orders + 1):
        r.grams()
        r.take(row[f"r{k}"] or [])
    return r


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def _send(stats: dict, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            r = _replayed(row, stats, order - 1)
            r.grams()
            shard, data = zip(*r.messages(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([row["block"]] * len(shard)), pa.array(data, pa.binary())], ["shard", "block", "data"])

    return run


def build(messages: list[list[np.ndarray]], order: int) -> tuple[Trie, np.ndarray, np.ndarray, list[np.ndarray], int]:
    """A shard's trie; the distinct (contexts, words) asked for, in order; the place of each message's in them; the number of its n-grams."""
    contexts, place = np.unique(np.concatenate([np.cumsum(m[0]) for m in messages]), return_inverse=True)
    keys, at, asked = [], 0, []
    for m in messages:
        own = place[at : at + len(m[0])]
        at += len(m[0])
        keys.append(np.repeat(own.astype(U) << U(32), m[1].astype(np.int64)) | m[2])
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    asked = np.split(where, np.cumsum([len(k) for k in keys])[:-1])
    del keys
    ctx, succ = contexts[(key >> U(32)).astype(np.int64)], (key & U(0xFFFFFFFF)).astype(np.uint32)
    count = np.bincount(where, np.concatenate([m[3] for m in messages]), minlength=len(key)).astype(np.int64)
    seen = count > 0
    codes = np.zeros(int(seen.sum()), np.uint16)
    if order > 1:
        lower, of = np.zeros(len(key), np.uint16), np.zeros(len(key), np.int64)
        lower[where] = np.concatenate([m[4] for m in messages])
        of[where] = np.concatenate([np.repeat(m[5].astype(np.int64), m[1].astype(np.int64)) for m in messages])
        codes = _quantise(np.log10((count[seen] + MU * 10 ** _value(lower[seen])) / (of[seen] + MU)))
    return Trie.build(ctx[seen], succ[seen], count[seen], codes).mapped(), ctx, succ, asked, len(codes)


def _answer(order: int):
    def run(table: pa.Table) -> pa.Table:
        trie, ctx, succ, asked, types = build([split(x.as_py()) for x in table["data"]], order)
        at = trie.find(ctx, succ)
        hit = at >= 0
        count, code = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint16)
        count[hit], code[hit] = trie.counts(at[hit]), trie.codes[at[hit]]
        out = [join([narrow(count[w])] if order == 1 else [narrow(count[w]), code[w]]) for w in asked]
        n = len(out)
        return pa.table({"shard": table["shard"], "block": table["block"], "data": pa.array(out, pa.binary()), "types": pa.array([types] + [0] * (n - 1), pa.int64()), "bytes": pa.array([trie.n_bytes()] + [0] * (n - 1), pa.int64())})

    return run


ANSWER = "shard int, block long, data binary, types long, bytes long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(stats: dict, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            r = _replayed(row, stats, order)
            size, known, base, score = r.documents()
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.ids, pa.int64()), pa.array(r.held), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(size), stats["tokens"])), pa.array(base), pa.array(score)], [f.split()[0] for f in SCORES.split(", ")]
            )

    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` kept in the shared folder, bucketed by block, so joins by block move only the other side."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, "block").saveAsTable(table)
    return spark.table(table)


def _buckets(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of every row of ``docs(doc_id, held, text)``; the model learns from the rows that are not held."""
    spark = docs.sparkSession
    buckets = _buckets(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("held").alias("held"), F.col("text").cast("string").alias("text"))
    blocks = _bucketed(in_batches(rows, _blocks, BLOCK_SCHEMA), "blocks", buckets)
    seen = F.expr("aggregate(zip_with(sizes, held, (s, h) -> if(h, 0L, cast(s as bigint))), 0L, (a, x) -> a + x)")
    total = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.sum(seen), F.sum(F.expr("size(filter(held, h -> not h))"))).first()
    stats = {"tokens": total[1] or 0, "docs": total[2] or 0, "shards": int((total[0] or 0) // SHARD + 1), "vocabulary": 0}
    state = blocks
    for k in range(1, order + 1):
        sent = in_batches(state, _send(dict(stats), k), "shard int, block long, data binary")
        answers = materialise(sent.groupBy("shard").applyInArrow(_answer(k), ANSWER), "answers")
        if k == 1:
            stats["vocabulary"] = answers.agg(F.sum("types")).first()[0] or 0
        by_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias(f"r{k}"))
        state = state.join(by_block, "block")
        del sent
        collect_garbage(spark)
    return in_batches(state, _score(dict(stats), order), SCORES)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learned from the rows whose id's remainder modulo 5 is not 1; scores all rows."""
    return score_texts(docs.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 1).alias("held"), "text"))
