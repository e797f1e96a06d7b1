"""N-gram Jaccard self-join with prefix filters under several token orders.

Documents whose sets of word n-grams reach a Jaccard similarity link; the
result is each document's component.  Steps:

1.  Equal sets collapse: a set's id is a 64-bit sum over its shingles' hashes,
    so exact copies, however many, become one node before anything is joined.
2.  First order: shingles are ranked by (hash block, number of nodes that hold
    them, hash).  A pair that reaches the threshold must share one of the first
    ``n - ceil(t * n) + 1`` shingles of each side.  Within a block rare ones
    come first, so a passage that thousands of documents repeat stays out of
    their prefixes.  A document sends only the blocks its prefix needs.
3.  In each bucket of a prefix shingle the node with the fewest shingles of its
    own is paired with the others (linear in the bucket).  A pair stays a
    candidate only if its prefixes under the other orders (independent hash
    orders) meet as well; these are small and move first.  Only for what is left
    do the sets move, and the exact overlap decides.  Linked nodes contract to
    components.
4.  What still shares buckets across components is compared in blocks, in
    memory, by the same filters and the same test.  Nodes that meet, directly
    or through others, are a family.  A family that fits a side is one block; a
    larger one is cut by size (sets whose sizes cannot reach the threshold never
    meet) and by shared shingle into sides, and only sides that share a bucket
    are compared.  A block gives at most a spanning forest of its links: no link
    between components is lost and no list of pairs is ever written.

Shingles that a sample shows to be in very many nodes come last in their block,
whatever their number, so they need no count and no task sorts all rows of one;
everything else by shingle is a sum with partial sums.  (Any order of shingles
gives the same links.)

Nulls: a null or wordless text has an empty set, n_shingles 0 and links with
nothing; its component is its own doc_id.  A text of fewer than n words is one
shingle.  A null doc_id never becomes a component id unless all of its
component's are null.  Repeated rows give repeated rows.  Columns other than
the id and the text are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import collect_garbage, drop, fresh, in_batches, materialise
from .text import U, mix, shingles, word_batches

#: Ends of the first order's hash blocks as parts of the hash range.
BLOCKS = (0.3, 0.6)
#: Sets of at most this size send all shingles, so that their order is by frequency throughout.
SMALL = 32
#: Seeds of the further orders under which a pair must share prefix shingles.
ORDERS = (11, 23)
#: Nodes that hold a shingle, and part of all nodes, from which on it is not counted; one node of so many is in the sample that tells.
HOT, HOT_PART, SAMPLED = 2000, 1000, 32
#: Nodes and shingles of a side of a block, about; and of what is compared at once within it.
SIDE, SIDE_SHINGLES = 2048, 500_000
TILE, TILE_SHINGLES = 1024, 250_000

_CUT = [int(b * 2**48) for b in BLOCKS]


def prefix_length(n, num: int, den: int):
    """Shingles of a set of n among which a partner at num/den or more must share one."""
    return n - -(-n * num // den) + 1


def doc_sets(ids: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document."""
    at = 0
    for c in counts.tolist():
        s = np.sort(shingles(ids[at : at + c], n))
        at += c
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, 5).sum(dtype=U) + U(len(s))], U), 7).view(np.int64)[0])


def _sketch(n: int, num: int, den: int):
    """Batches of (id, text, h) to (id, h, node, n_shingles, e0, e1, toks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes whose shingles this task has sent
        for b in batches:
            for i, ids, counts in word_batches(b.column(1)):
                node, size, e0, e1, toks = [], [], [], [], []
                for s in doc_sets(ids, counts, n):
                    k = len(s)
                    x = set_id(s) if k else None
                    node.append(x)
                    size.append(k)
                    if not k or x in seen:
                        e0.append(0)
                        e1.append(0)
                        toks.append(None)
                        continue
                    seen.add(x)
                    t = (s >> U(16)).astype(np.int64)
                    a, c = np.searchsorted(t, _CUT).tolist()
                    p = prefix_length(k, num, den)
                    sent = k if k <= SMALL or c < p else c if a < p else a
                    e0.append(a)
                    e1.append(c - a)
                    toks.append(t[:sent])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, len(counts)), b.column(2).slice(i, len(counts)), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(e0, pa.int64()), pa.array(e1, pa.int64()), pa.array(toks, pa.list_(pa.int64()))],
                    ["id", "h", "node", "n_shingles", "e0", "e1", "toks"],
                )

    return run


def _hot(sent: DataFrame) -> DataFrame:
    """(tok): shingles of very many of the nodes of ``sent(node, toks)``; at most ``HOT_PART`` times a node's shingles."""
    need = max(HOT, sent.count() // HOT_PART) // SAMPLED
    sample = sent.where(F.pmod(F.xxhash64(F.lit("hot"), "node"), F.lit(SAMPLED)) == 0).select(F.explode("toks").alias("tok"))
    return materialise(sample.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("tok"), "hot")


def _shared(sent: DataFrame) -> DataFrame:
    """(tok, node, c): the shingles that more than one node holds, and how many do; of hot ones, and of what shares a bit with one, a number above all."""
    hot = _hot(sent)
    some = bool(hot.take(1))
    flat = sent.select("node", F.explode("toks").alias("tok"))
    marked = _bit(_bitmap(hot.select(F.col("tok").alias("k")), 4096), sent.sparkSession, F.col("tok")) if some else None
    cold = (flat.where(~marked) if some else flat).repartition("tok")
    by_node = Window.partitionBy("tok").orderBy("node")
    seen = cold.select("tok", "node", F.dense_rank().over(by_node).alias("r"), F.lag("node").over(by_node).alias("before"))
    out = seen.withColumn("c", F.max("r").over(Window.partitionBy("tok"))).where("c > 1 and (before is null or before <> node)").select("tok", "node", "c")
    if some:
        out = out.unionByName(flat.where(marked).dropDuplicates(["tok", "node"]).select("tok", "node", F.lit(2**31 - 1).alias("c")))
    return out


def _prefixes(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(tok, node, n, own): the shared shingles in each node's prefix under the first order."""
    sent = rows.where("toks is not null")
    shared = _shared(sent.select("node", "toks"))
    nodes = sent.select("node", F.col("n_shingles").alias("n"), "e0", "e1").dropDuplicates(["node"])
    block = F.when(F.col("tok") < _CUT[0], 0).when(F.col("tok") < _CUT[1], 1).otherwise(2)
    own = Window.partitionBy("node", "block")
    return (
        shared.join(nodes, "node")
        .withColumn("block", block)
        .withColumn("rn", F.row_number().over(own.orderBy("c", "tok")))
        .withColumn("shared", F.count("*").over(own))
        .withColumn("size", F.expr("case block when 0 then e0 when 1 then e1 else n - e0 - e1 end"))
        .withColumn("rank", F.expr("case block when 0 then 0 when 1 then e0 else e0 + e1 end + size - shared + rn"))
        .where(F.col("rank") <= prefix_sql(num, den))
        .select("tok", "node", "n", ((F.col("size") - F.col("shared")) / F.greatest(F.col("size"), F.lit(1))).alias("own"))
    )


def prefix_sql(num: int, den: int):
    """prefix_length() as a column expression over n, in whole numbers."""
    return F.expr(f"n - ((n * {num} + {den} - 1) div {den}) + 1")


def _bitmap(keys: DataFrame, each: int = 16) -> np.ndarray:
    """A bitmap of hashed keys ``k`` with ``each`` bits a key, of at most 16 MB however many they are: bit k modulo its length is set for each."""
    bits = 1 << min(27, max(10, (each * max(keys.count(), 1)).bit_length()))
    slots = keys.select(F.expr(f"k & {bits - 1}L").alias("s")).select(F.expr("s >> 6").alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    got = slots.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _bit(bitmap: np.ndarray, spark: SparkSession, key: Column) -> Column:
    """Whether the key's bit is set."""
    bits = spark.createDataFrame(pa.table({"bits": pa.array([bitmap], pa.list_(pa.int64()))})).scalar()
    slot = key.bitwiseAND(F.lit(len(bitmap) * 64 - 1))
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def order_prefixes(s: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """A set's prefix under each further order, as sorted 32-bit values."""
    p = prefix_length(len(s), num, den)
    out = []
    for seed in ORDERS:
        k = mix(s, seed)
        out.append(np.sort(((np.partition(k, p - 1)[:p] if p < len(k) else k) >> U(32)).astype(np.uint32)))
    return out


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays share a value."""
    return bool((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).any())


_FILTERS = [f"f{k}" for k in range(len(ORDERS))]


def _sets(docs: DataFrame, wanted: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, shingles, f0, f1 ...) of the wanted nodes, from the texts: the set, and its prefix under each further order.

    A bitmap keeps most other sets from leaving their task; what it lets through
    by chance costs time and is joined away.
    """
    known = _bitmap(wanted.select(F.col("node").alias("k")))
    last = len(known) * 64 - 1
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, ids, counts in word_batches(b.column(0)):
                node, sets, first = [], [], []
                for s in doc_sets(ids, counts, n):
                    if len(s) and (x := set_id(s)) not in seen and int(sent.value[(x & last) >> 6]) >> (x & 63) & 1:
                        seen.add(x)
                        node.append(x)
                        sets.append(s.tobytes())
                        first.append([p.tobytes() for p in order_prefixes(s, num, den)])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary()), *[pa.array([f[k] for f in first], pa.binary()) for k in range(len(ORDERS))]], ["node", "shingles", *_FILTERS])

    return in_batches(docs, run, f"node long, shingles binary, {', '.join(f'{f} binary' for f in _FILTERS)}").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """The exact test; a and b are sorted."""
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _both(pairs: DataFrame, sets: DataFrame, columns: list[str], keep) -> DataFrame:
    """The pairs (u, v) whose nodes' columns of ``sets`` ``keep`` takes."""
    k = len(columns)
    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [keep([x.as_buffer() for x in row[:k]], [x.as_buffer() for x in row[k:]]) for row in zip(*batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(said, pa.bool_()))

    return in_batches(pairs.select("u", "v", *[f"{side}_{c}" for side in ("u", "v") for c in columns]), run, "u long, v long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that reach the threshold: those that meet under every order, then those whose overlap is enough."""
    candidates = _both(pairs, sets, _FILTERS, lambda u, v: all(meet(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(u, v, strict=True)))
    return _both(candidates, sets, ["shingles"], lambda u, v: similar(np.frombuffer(u[0], U), np.frombuffer(v[0], U), num, den))


def _counts(rows: np.ndarray, cols: np.ndarray, half: int, n: int, width: int) -> np.ndarray:
    """For rows < half against rows >= half: how many columns both have."""
    out = np.zeros((half, n - half), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, width, 2048):
        i, j = np.searchsorted(cols, (at, at + 2048))
        m = np.zeros((n, min(2048, width - at)), np.float32)
        m[rows[i:j], cols[i:j] - at] = 1
        out += m[:half] @ m[half:].T
    return out


def tile_links(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a left and a right set that are similar: prefix filters under every further order, then the overlap."""
    sets, half = left + right, len(left)
    size = np.array([len(s) for s in sets])
    may = (den * np.minimum.outer(size[:half], size[half:]) >= num * np.maximum.outer(size[:half], size[half:])).astype(bool)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not may.any():
        return none
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, col, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    p = prefix_length(size, num, den)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    for seed in ORDERS:
        by = np.lexsort((mix(flat, seed), row))
        first = by[np.arange(len(flat)) - start[row] < p[row]]
        first = first[shared[col[first]]]
        may &= _counts(row[first], place[col[first]], half, len(sets), int(shared.sum())) > 0
        if not may.any():
            return none
    kept = np.concatenate((may.any(1), may.any(0)))[row] & shared[col]
    both = _counts(row[kept], place[col[kept]], half, len(sets), int(shared.sum()))
    return np.nonzero(may & (den * both >= num * (np.add.outer(size[:half], size[half:]) - both)))


def _tiles(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Ranges of at most ``TILE`` sets and about ``TILE_SHINGLES`` shingles."""
    cuts, total = [0], 0
    for i, s in enumerate(sets):
        if i > cuts[-1] and (i - cuts[-1] >= TILE or total + len(s) > TILE_SHINGLES):
            cuts.append(i)
            total = 0
        total += len(s)
    return list(zip(cuts, [*cuts[1:], len(sets)], strict=True))


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of similar pairs of two sides, or of one side (``right`` None), tile by tile."""
    mine = _tiles(left)
    for k, (a, b) in enumerate(mine):
        for c, d in mine[k:] if right is None else _tiles(right):
            x, y = tile_links(left[a:b], (left if right is None else right)[c:d], num, den)
            yield x + a, y + c


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (u, v), enough to connect what they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            out.append((x, y))
    return out


def _placed(meets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(family, side, node, comp) of the nodes that meet, and (family, i, j) of the sides to compare.

    A family that fits a side is side 0.  Of a larger one a side holds sets of one
    band of sizes, each band a bit wider than the threshold's ratio, so a set finds
    its partners in its band and the two beside it.  Within a band nodes are dealt
    by their lowest shared shingle, a frequent one over several sides.
    """
    fam = components(meets.select(F.col("node").alias("u"), F.col("low").alias("v"))).select("node", F.col("comp").alias("family"))
    members = materialise(meets.groupBy("node").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.min("tok").alias("first")).join(fam, "node"), "members")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(float(SIDE))), F.ceil(F.sum("n") / F.lit(float(SIDE_SHINGLES)))).cast("int")
    large = materialise(members.groupBy("family").agg(parts.alias("k")).where("k > 1").select("family"), "large")
    small = members.join(large, "family", "left_anti").select("family", F.lit(0).cast("long").alias("side"), "node", "comp")
    pairs = small.select("family", F.col("side").alias("i"), F.col("side").alias("j")).distinct()
    if not large.take(1):
        return small, pairs
    banded = members.join(large, "family").withColumn("band", F.floor(F.ln("n") / math.log(1.0001 * den / num)).cast("long"))
    sides = banded.groupBy("family", "band").agg(parts.alias("k"))
    hot = banded.groupBy("family", "band", "first").agg(parts.alias("split"))
    side = F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("node"), "split")), "k") + F.col("band") * F.lit(1 << 32)
    cut = materialise(banded.join(sides, ["family", "band"]).join(hot, ["family", "band", "first"]).select("family", side.alias("side"), "node", "comp"), "cut")
    met = meets.select("tok", "node").join(cut.select("family", "side", "node"), "node").groupBy("tok").agg(F.first("family").alias("family"), F.sort_array(F.collect_set("side")).alias("sides")).select("family", "sides").distinct()
    two = met.select("family", "sides", F.explode("sides").alias("i")).select("family", "i", F.explode("sides").alias("j"))
    near = two.where("i <= j and (j >> 32) - (i >> 32) <= 1").distinct()
    return small.unionByName(cut), pairs.unionByName(near)


def _rest(meets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links between the components that still meet in a bucket; each pair of sides is one group, which holds two sides' sets and nothing else."""
    placed, pairs = _placed(meets, num, den)
    plan = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side")).groupBy("family", "side").agg(F.collect_list(F.struct("i", "j")).alias("blocks"))
    dealt = placed.join(plan, ["family", "side"]).join(sets.select("node", "shingles"), "node").select("family", "side", "node", "comp", "shingles", F.explode("blocks").alias("b")).select("family", "b.i", "b.j", "side", "node", "comp", "shingles")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, node, comp = (table[c].to_numpy() for c in ("side", "node", "comp"))
        found = [np.frombuffer(x.as_buffer(), U) for c in table["shingles"].chunks for x in c]
        by = np.lexsort((node, [len(s) for s in found]))
        lo, hi = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = by[side[by] == lo], by[side[by] == hi]
        own: list[tuple[int, int]] = []
        for x, y in block_links([found[k] for k in a], [found[k] for k in b] if lo != hi else None, num, den):
            x, y = a[x], b[y]
            cross = comp[x] != comp[y]
            own = _forest(*np.array([*own, *zip(node[x[cross]].tolist(), node[y[cross]].tolist(), strict=True)], np.int64).reshape(-1, 2).T)
        return pa.table({"u": pa.array([p for p, _ in own], pa.int64()), "v": pa.array([q for _, q in own], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(run, "u long, v long")


def _links(docs: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, comp) of the nodes that link with another; empty if none does."""
    spark = docs.sparkSession
    prefixes = materialise(_prefixes(rows, num, den), "prefixes")
    collect_garbage(spark)
    lead = prefixes.groupBy("tok").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(F.struct("own", "node", "n")).alias("lead")).where("lo <> hi").select("tok", "lead")
    meeting = materialise(prefixes.join(lead, "tok").select("tok", "node", "n", F.col("lead.node").alias("node2"), F.col("lead.n").alias("n2")), "meeting")
    drop(prefixes)
    fits = f"{den} * least(n, n2) >= {num} * greatest(n, n2)"
    pairs = materialise(meeting.where(f"node <> node2 and {fits}").select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct(), "pairs")
    sets = materialise(_sets(docs, meeting.select("node").distinct(), n, num, den), "sets")
    collect_garbage(spark)
    found = materialise(_verify(pairs, sets, num, den), "found")
    drop(pairs)
    comps = materialise(components(found), "comps")
    collect_garbage(spark)
    now = meeting.select("tok", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    still = now.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("low")).where("lo <> hi").select("tok", "low")
    meets = materialise(now.join(still, "tok").select("tok", "node", "low", "comp", "n"), "meets")
    drop(meeting)
    if meets.take(1):
        more = materialise(_rest(meets, sets, num, den), "found")
        comps = materialise(components(found.unionByName(more)), "comps")
        collect_garbage(spark)
    for used in (sets, meets):
        drop(used)
    return comps


def classes(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n_shingles, class, component_id) for each row; h is a hash of the text, class null for an empty set."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = materialise(in_batches(source, _sketch(n, num, den), "id long, h long, node long, n_shingles long, e0 long, e1 long, toks array<long>"), "sketch")
    comps = _links(source.select("text"), rows, n, num, den)
    lows = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    merged = lows.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("class"), "low")
    named = merged.join(merged.groupBy("class").agg(F.min("low").alias("component_id")), "class").select("node", "class", "component_id")
    return rows.select("id", "h", "node", "n_shingles").join(named, "node", "left").drop("node")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row; see the module's text."""
    return classes(docs, n, num, den, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null last).

    Of rows that share this id the text with the smallest hash stays, of equal
    rows one.  Rows without a word all stay.
    """
    found = materialise(classes(docs, n, num, den, id_col, text_col).where("class is not null").select("id", "h", "class"), "classes")
    mark = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    keepers = found.groupBy("class").agg(F.min(mark).alias("k"), F.count("*").alias("n")).where("n > 1").select("class", "k")
    judged = found.join(keepers, "class").select("id", "h", (mark == F.col("k")).alias("stays"))
    own_id, own_h, own_gone, own_rn = fresh(docs, "_id", "_h", "_gone", "_rn")
    key = [F.col("id").alias(own_id), F.col("h").alias(own_h)]
    gone = judged.where("not stays").select(*key).distinct()
    twice = judged.where("stays").groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select(*key)
    marks = materialise(gone.withColumn(own_gone, F.lit(True)).unionByName(twice.withColumn(own_gone, F.lit(False))), "marks")
    mine = [F.col(f"`{c}`") for c in docs.columns]
    row_id, row_h = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    # A bitmap tells most unmarked rows from the marked ones, so their texts stay where they are.
    maybe = _bit(_bitmap(marks.select(F.xxhash64(own_id, own_h).alias("k"))), docs.sparkSession, F.xxhash64(row_id, row_h))
    here = row_id.eqNullSafe(F.col(own_id)) & (row_h == F.col(own_h))
    out = docs.where(~maybe).union(docs.where(maybe).join(marks, here, "left_anti").select(*mine))
    if marks.where(~F.col(own_gone)).take(1):
        first = F.min_by(F.struct(*mine), F.array(*[c.cast("string") for c in mine])).alias(own_rn)
        out = out.union(docs.where(maybe).join(marks.where(~F.col(own_gone)), here).groupBy(own_id, own_h).agg(first).select(f"{own_rn}.*"))
    return out
