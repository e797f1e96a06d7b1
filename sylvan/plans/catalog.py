"""Named queries over the test tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions import sequences as S
from ..functions import series as TS
from ..operators import missing, pareto, patterns, score, shapelets, splits
from ..operators.tree import Node, Options, Split, Tree, fit, infer_kinds, normalise
from ..sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def xl(x: str) -> str:
    return f"(CASE WHEN {x} < 1e-6 THEN 0 ELSE {x} * ln({x}) END)"


def sxl(x: str) -> str:
    return f"sum({xl(x)})"


GAINED = "CASE WHEN abs(o - n) < 1e-6 THEN 0 ELSE (known / weight) * (o - n) / known END"

# -- rows in long form, as SQL: attr, v, c (class)
NUMERIC_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS v, l_returnflag AS c FROM lineitem" for a in X.NUMERIC)
LINES = "SELECT l.*, p.p_type, p.p_brand FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey"
NOMINAL_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS v, l_returnflag AS c FROM ({LINES}) x" for a in X.NOMINAL)
GAPS = "SELECT * REPLACE (CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_linenumber % 4 <> 0 THEN l_linestatus END AS l_linestatus) FROM lineitem"


def scan_sql(rows: str) -> str:
    """CTEs ending in ``scan(attr, lower, upper, left_w, right_w, gain, weight, known, k, n_rows)``."""
    return f"""
WITH r AS ({rows}),
t AS (SELECT attr, count(*)::DOUBLE AS weight, count(v)::DOUBLE AS n_rows, (SELECT count(DISTINCT c) FROM r) AS k FROM r GROUP BY attr),
g AS (SELECT attr, v, c, count(*)::DOUBLE AS n FROM r WHERE v IS NOT NULL GROUP BY attr, v, c),
vals AS (SELECT DISTINCT attr, v FROM g), cls AS (SELECT DISTINCT c FROM r),
d AS (SELECT vals.attr, vals.v, cls.c, coalesce(g.n, 0) AS n FROM vals CROSS JOIN cls LEFT JOIN g ON g.attr = vals.attr AND g.v = vals.v AND g.c = cls.c),
w AS (SELECT attr, v, c, sum(n) OVER (PARTITION BY attr, c ORDER BY v) AS l, sum(n) OVER (PARTITION BY attr, c) AS a FROM d),
u AS (SELECT attr, v, lead(v) OVER (PARTITION BY attr ORDER BY v) AS upper FROM vals),
s AS (SELECT attr, v, sum(l) AS left_w, sum(a - l) AS right_w, sum(a) AS known, ({xl("sum(a)")} - {sxl("a")}) / ln(2) AS o,
        ({xl("sum(l)")} - {sxl("l")} + {xl("sum(a - l)")} - {sxl("(a - l)")}) / ln(2) AS n FROM w GROUP BY attr, v),
scan AS (SELECT s.attr, s.v AS lower, u.upper, left_w, right_w, known, weight, n_rows, k, {GAINED} AS gain
  FROM s JOIN u ON u.attr = s.attr AND u.v = s.v JOIN t ON t.attr = s.attr WHERE u.upper > s.v + 1e-5)"""


BEST = """,
f AS (SELECT *, CASE WHEN 0.1 * known / k <= 2 THEN 2.0 WHEN 0.1 * known / k > 25 THEN 25.0 ELSE 0.1 * known / k END AS floor FROM scan),
e AS (SELECT *, count(*) OVER (PARTITION BY attr) AS candidates, row_number() OVER (PARTITION BY attr ORDER BY -round(gain, 12), lower) AS rn FROM f WHERE left_w >= floor - 1e-6 AND right_w >= floor - 1e-6 AND n_rows >= 2 * floor - 1e-6),
best AS (SELECT attr, (lower + upper) / 2 AS threshold, lower, candidates, gain AS raw_gain, gain - log2(candidates) / weight AS gain FROM e WHERE rn = 1)"""

NOMINAL = f"""
WITH r AS ({NOMINAL_ROWS}),
g AS (SELECT attr, v, c, count(*)::DOUBLE AS n FROM r GROUP BY attr, v, c),
b AS (SELECT attr, v, sum(n) AS bag, {xl("sum(n)")} - {sxl("n")} AS h FROM g WHERE v IS NOT NULL GROUP BY attr, v),
k AS (SELECT attr, c, sum(n) AS n FROM g WHERE v IS NOT NULL GROUP BY attr, c),
o AS (SELECT attr, sum(n) AS known, ({xl("sum(n)")} - {sxl("n")}) / ln(2) AS o FROM k GROUP BY attr),
m AS (SELECT b.attr, count(*) AS bags, count(*) FILTER (WHERE bag >= 2 - 1e-6) AS big, sum(h) / ln(2) AS n FROM b GROUP BY b.attr),
z AS (SELECT attr, sum(n) AS weight FROM g GROUP BY attr),
multi AS (SELECT attr, bags, big, known, weight, {GAINED} AS gain FROM m JOIN o USING (attr) JOIN z USING (attr))"""


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    return splits.long_form(X.table(spark, d, "lineitem"), X.NUMERIC, "double", "l_returnflag")


def _nominal(spark: SparkSession, d: str) -> DataFrame:
    return splits.long_form(X.lines(spark, d), X.NOMINAL, "string", "l_returnflag")


ATTR = ("attr",)
FLAGS = ["A", "N", "R"]


def r9(c: str, name: str | None = None):
    return F.round(c, 9).alias(name or c)


# -- 1. static splits


@query("SELECT l_returnflag AS label, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1")
def class_distribution(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.lit(1.0).alias("w"))
    return splits.distribution(rows, ["label"])


@query(f"SELECT attr, v AS value, c AS label, count(*)::DOUBLE AS w FROM ({NOMINAL_ROWS}) r GROUP BY 1, 2, 3")
def contingency_nominal(spark, d):
    return splits.distribution(_nominal(spark, d), ["attr", "value", "label"])


@query(f"SELECT sum(n) AS weight, count(*)::BIGINT AS classes, round(({xl('sum(n)')} - {sxl('n')}) / ln(2) / sum(n), 9) AS entropy FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag)")
def entropy_class(spark, d):
    g = class_distribution(spark, d)
    return g.agg(F.sum("w").alias("weight"), F.count("*").alias("classes"), F.round((C.xlnx(F.sum("w")) - F.sum(C.xlnx(F.col("w")))) / C.LN2 / F.sum("w"), 9).alias("entropy"))


@query(f"{NOMINAL} SELECT attr, bags, round(gain, 9) AS gain, round(gain / log2(bags), 9) AS score, big > 1 AS valid FROM multi")
def infogain_nominal_multiway(spark, d):
    return splits.nominal_multiway(_nominal(spark, d), FLAGS, keys=ATTR).select("attr", "bags", r9("gain"), r9("score"), "valid")


@query(f"{scan_sql(NUMERIC_ROWS)} SELECT attr, lower, upper, left_w, right_w, round(gain, 9) AS gain FROM scan")
def numeric_threshold_scan(spark, d):
    return splits.numeric_scan(_numeric(spark, d), FLAGS, keys=ATTR).select("attr", "lower", "upper", F.col("left").alias("left_w"), F.col("right").alias("right_w"), r9("gain"))


@query(f"{scan_sql(NUMERIC_ROWS)} {BEST} SELECT attr, round(threshold, 9) AS threshold, lower, candidates, round(raw_gain, 9) AS raw_gain, round(gain, 9) AS gain, gain > 1e-6 AS valid FROM best")
def numeric_best_split(spark, d):
    return splits.best_threshold(_numeric(spark, d), FLAGS, keys=ATTR).select("attr", r9("threshold"), "lower", "candidates", r9("raw_gain"), r9("gain"), (F.col("gain") > C.EPS).alias("valid"))


ONE_REST = f"""{NOMINAL},
x AS (SELECT v.attr, v.v, k.c, k.n AS a, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT attr, v FROM g WHERE v IS NOT NULL) v JOIN k ON k.attr = v.attr LEFT JOIN g ON g.attr = v.attr AND g.v = v.v AND g.c = k.c),
y AS (SELECT attr, v, sum(a) AS known, sum(n) AS own, ({xl("sum(a)")} - {sxl("a")}) / ln(2) AS o, ({xl("sum(n)")} - {sxl("n")} + {xl("sum(a - n)")} - {sxl("(a - n)")}) / ln(2) AS n FROM x GROUP BY attr, v),
ovr AS (SELECT y.attr, v, own, known, {GAINED} AS gain FROM y JOIN z ON z.attr = y.attr)"""


@query(f"{ONE_REST} SELECT attr, v AS value, round(gain, 9) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY -round(gain, 12), v) AS rn FROM ovr WHERE own >= 2 AND known - own >= 2 AND gain > 1e-6) WHERE rn = 1")
def nominal_binary_best(spark, d):
    return splits.best_value(_nominal(spark, d), FLAGS, keys=ATTR).select("attr", "value", r9("gain"))


@query(
    f"{scan_sql(NUMERIC_ROWS)} {BEST}, nom AS ({NOMINAL} SELECT attr, gain / log2(bags) AS score FROM multi WHERE big > 1),"
    " a AS (SELECT attr, gain AS score, 'numeric' AS kind FROM best UNION ALL SELECT attr, score, 'nominal' FROM nom)"
    " SELECT attr, kind, round(score, 9) AS score, row_number() OVER (ORDER BY -round(score, 12), attr) AS place FROM a WHERE score > 1e-6"
)
def best_attribute(spark, d):
    num = splits.best_threshold(_numeric(spark, d), FLAGS, keys=ATTR).select("attr", F.col("gain").alias("score"), F.lit("numeric").alias("kind"))
    nom = splits.nominal_multiway(_nominal(spark, d), FLAGS, keys=ATTR).where("valid").select("attr", "score", F.lit("nominal").alias("kind"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(-F.round("score", 12), "attr")).cast("bigint")  # one row an attribute
    return num.unionByName(nom).where(F.col("score") > C.EPS).select("attr", "kind", r9("score"), place.alias("place"))


@query(f"{scan_sql(NUMERIC_ROWS)} {BEST} SELECT b.attr, round(max(threshold), 9) AS threshold, max(r.v) AS actual FROM best b JOIN r ON r.attr = b.attr AND r.v <= b.threshold + 1e-6 GROUP BY b.attr")
def splitpoint_relocate(spark, d):
    best = splits.best_threshold(_numeric(spark, d), FLAGS, keys=ATTR).select("attr", "threshold")
    return splits.relocate(X.table(spark, d, "lineitem"), best, X.NUMERIC, ATTR).select("attr", r9("threshold"), "actual")


@query(
    f"""{NOMINAL},
q AS (SELECT b.attr, b.v, k.c, b.bag, coalesce(g.n, 0) AS n FROM b JOIN k ON k.attr = b.attr LEFT JOIN g ON g.attr = b.attr AND g.v = b.v AND g.c = k.c),
p AS (SELECT attr, c, sum({xl("bag")} - {xl("n")} - {xl("(bag - n)")}) / ln(2) AS n FROM q GROUP BY attr, c),
y AS (SELECT k.attr, k.c, o.known, z.weight, ({xl("o.known")} - {xl("k.n")} - {xl("(o.known - k.n)")}) / ln(2) AS o, p.n FROM k JOIN o USING (attr) JOIN z USING (attr) JOIN p ON p.attr = k.attr AND p.c = k.c)
SELECT attr, c AS label, round({GAINED}, 9) AS gain FROM y"""
)
def infogain_one_vs_all(spark, d):
    return splits.class_gains(_nominal(spark, d), FLAGS, keys=ATTR).select("attr", "label", r9("gain"))


@query(f"{NOMINAL} SELECT attr, bags, big, big > 1 AS passes FROM multi")
def min_objects_check(spark, d):
    return splits.nominal_multiway(_nominal(spark, d), FLAGS, keys=ATTR).select("attr", "bags", "big", F.col("valid").alias("passes"))


@query(
    f"""WITH g AS (SELECT v AS bag, c, count(*)::DOUBLE AS n FROM ({NOMINAL_ROWS}) r WHERE attr = 'p_brand' AND v IS NOT NULL GROUP BY 1, 2),
x AS (SELECT b.bag, c.c, coalesce(g.n, 0) AS n, sum(coalesce(g.n, 0)) OVER (PARTITION BY b.bag) AS size FROM (SELECT DISTINCT bag FROM g) b CROSS JOIN (SELECT DISTINCT c FROM g) c LEFT JOIN g ON g.bag = b.bag AND g.c = c.c)
SELECT bag, c AS label, round(n / size, 9) AS prob, round((n + 1) / (size + 3), 9) AS laplace FROM x"""
)
def laplace_probs(spark, d):
    t = splits.contingency(_nominal(spark, d).where("attr = 'p_brand' and value is not null"), FLAGS, ATTR)
    size = C.total(splits.counts("c", 3))
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.round(F.col(f"c{i}") / size, 9).alias("prob"), F.round(C.laplace(F.col(f"c{i}"), size, 3), 9).alias("laplace")) for i, c in enumerate(FLAGS)])
    return t.select(F.col("value").alias("bag"), F.explode(cells).alias("x")).select("bag", "x.*")


# -- 2. unknown values


@query("SELECT d.doc_id, n_chars, lang, source, quality::VARCHAR AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def missing_class_drop(spark, d):
    return X.marked_documents(spark, d).where("quality is not null")


GAP_ROWS = f"SELECT 'l_quantity' AS attr, l_quantity AS v, l_returnflag AS c FROM ({GAPS}) x"


@query(f"{scan_sql(GAP_ROWS)} SELECT attr, lower, round(known / weight, 9) AS known_rate, round(gain, 9) AS gain FROM scan")
def infogain_unknown_rate(spark, d):
    rows = splits.long_form(X.lines_with_gaps(spark, d), ["l_quantity"], "double", "l_returnflag")
    return splits.numeric_scan(rows, FLAGS, keys=ATTR).select("attr", "lower", F.round(F.col("known") / F.col("weight"), 9).alias("known_rate"), r9("gain"))


@query(
    f"""WITH r AS (SELECT l_linestatus AS bag, l_returnflag AS label, count(*)::DOUBLE AS w FROM ({GAPS}) x GROUP BY 1, 2),
b AS (SELECT bag, sum(w) AS size FROM r WHERE bag IS NOT NULL GROUP BY bag), p AS (SELECT bag, size / sum(size) OVER () AS share FROM b),
a AS (SELECT bag, label, w FROM r WHERE bag IS NOT NULL UNION ALL SELECT p.bag, r.label, r.w * share FROM r CROSS JOIN p WHERE r.bag IS NULL)
SELECT bag, label, round(sum(w), 6) AS w FROM a GROUP BY 1, 2"""
)
def add_missing_mass(spark, d):
    rows = X.lines_with_gaps(spark, d).select(F.col("l_linestatus").alias("bag"), F.col("l_returnflag").alias("label"), F.lit(1.0).alias("w"))
    return missing.bag_counts(rows).select("bag", "label", F.round("w", 6).alias("w"))


@query(
    f"""WITH r AS (SELECT CASE WHEN l_quantity - 25 < 1e-6 THEN 0 WHEN l_quantity IS NOT NULL THEN 1 END AS bag, l_returnflag AS label FROM ({GAPS}) x),
a AS (SELECT bag, label, 1.0 AS w FROM r WHERE bag IS NOT NULL UNION ALL SELECT 0, label, 0.5 FROM r WHERE bag IS NULL UNION ALL SELECT 1, label, 0.5 FROM r WHERE bag IS NULL)
SELECT bag, label, sum(w)::DOUBLE AS w FROM a GROUP BY 1, 2"""
)
def fractional_routing(spark, d):
    rows = X.lines_with_gaps(spark, d).select("l_quantity", F.col("l_returnflag").alias("label"), F.lit(1.0).alias("w"))
    routed = missing.route(rows, Split("threshold", "l_quantity", threshold=25.0).branch(), [0.5, 0.5])
    return routed.groupBy("bag", "label").agg(F.sum("w").alias("w"))


# -- 3. sequences

SEQS = """
WITH it AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) AS h, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY 1, 2, 3),
sq AS (SELECT user_id || '/' || day AS sid, CAST(user_id % 3 AS VARCHAR) AS label, list(items ORDER BY h) AS seq FROM it GROUP BY user_id, day),
tx AS (SELECT sid, label, seq, array_to_string(list_transform(seq, lambda x: array_to_string(x, ',')), '>') AS text FROM sq),
pl AS (SELECT sid, label, seq, unnest(range(1, len(seq) + 1)) AS tid FROM sq),
ids AS (SELECT sid, label, tid, unnest(seq[tid]) AS item FROM pl)"""


def _ids(spark, d):
    return patterns.id_list(X.event_sequences(spark, d))


@query(f"{SEQS} SELECT item, CAST(dense_rank() OVER (ORDER BY item) AS INTEGER) AS code FROM (SELECT DISTINCT item FROM ids)")
def item_dictionary(spark, d):
    return patterns.item_dictionary(_ids(spark, d))


@query(f"{SEQS} SELECT sid, label, text FROM tx")
def sequence_assemble(spark, d):
    return X.event_sequences(spark, d).select("sid", "label", "text")


@query(f"{SEQS} SELECT sid, CAST(len(seq) AS INTEGER) AS itemsets, text AS again FROM tx")
def sequence_parse(spark, d):
    seq = S.parse(F.col("text"))
    return X.event_sequences(spark, d).select("sid", F.size(seq).alias("itemsets"), S.text(seq).alias("again"))


@query(f"{SEQS} SELECT item, count(DISTINCT sid) AS support FROM ids GROUP BY item")
def item_support(spark, d):
    return patterns.item_support(_ids(spark, d))


@query(f"{SEQS} SELECT item, count(DISTINCT sid) AS support FROM ids GROUP BY item HAVING count(DISTINCT sid) >= ceil(0.35 * (SELECT count(*) FROM sq))")
def frequent_items(spark, d):
    n = X.event_sequences(spark, d).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 0.35)).alias("need"))
    return patterns.item_support(_ids(spark, d)).join(F.broadcast(n), F.col("support") >= F.col("need")).select("item", "support")


@query(f"{SEQS} SELECT x.item AS a, y.item AS b, count(DISTINCT x.sid) AS support FROM ids x JOIN ids y ON x.sid = y.sid AND x.tid = y.tid AND x.item < y.item GROUP BY 1, 2")
def cooc_equals(spark, d):
    return patterns.pairs(_ids(spark, d), later=False)


@query(f"{SEQS} SELECT x.item AS a, y.item AS b, count(DISTINCT x.sid) AS support FROM ids x JOIN ids y ON x.sid = y.sid AND x.tid < y.tid GROUP BY 1, 2")
def cooc_after(spark, d):
    return patterns.pairs(_ids(spark, d), later=True)


@query(f"{SEQS} SELECT x.item AS a, y.item AS b, count(DISTINCT x.sid) AS support FROM ids x JOIN ids y ON x.sid = y.sid AND y.tid > x.tid AND y.tid - x.tid <= 2 GROUP BY 1, 2")
def sstep_gap_support(spark, d):
    ids = _ids(spark, d)
    return patterns.step_support(patterns.s_step(ids, ids, 2))


@query(f"{SEQS} SELECT x.item AS a, y.item AS b, count(DISTINCT x.sid) AS support FROM ids x JOIN ids y ON x.sid = y.sid AND x.tid = y.tid AND y.item > x.item GROUP BY 1, 2")
def istep_support(spark, d):
    ids = _ids(spark, d)
    return patterns.step_support(patterns.i_step(ids, ids))


PATTERNS = [("click>view", 2), ("view>click", 1), ("click>view", 0), ("click,view>error", 2), ("signup>view>purchase", 3)]


@query(f"{SEQS} " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, CAST({g} AS INTEGER) AS gap, label, count(*) AS n FROM tx WHERE regexp_matches(text, '{S.regex(S.from_text(p), g)}') GROUP BY label" for p, g in PATTERNS))
def contains_regex(spark, d):
    seqs = X.event_sequences(spark, d)
    cells = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(g).alias("gap"), S.contains_regex(F.col("text"), S.from_text(p), g).alias("hit")) for p, g in PATTERNS])
    return seqs.select("label", F.explode(cells).alias("x")).where("x.hit").groupBy("x.pattern", "x.gap", "label").agg(F.count("*").alias("n"))


@query(ORACLE["contains_regex"])
def contains_structural(spark, d):
    seqs = X.event_sequences(spark, d)
    cells = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(g).alias("gap"), S.contains(F.col("seq"), S.from_text(p), g).alias("hit")) for p, g in PATTERNS])
    return seqs.select("label", F.explode(cells).alias("x")).where("x.hit").groupBy("x.pattern", "x.gap", "label").agg(F.count("*").alias("n"))


GAINS = f"""{SEQS},
hit AS (SELECT DISTINCT item AS pattern, 1 AS length, sid, label FROM ids
  UNION SELECT DISTINCT x.item || '>' || y.item, 2, x.sid, x.label FROM ids x JOIN ids y ON x.sid = y.sid AND y.tid > x.tid AND y.tid - x.tid <= 2),
n AS (SELECT label, count(*)::DOUBLE AS a FROM sq GROUP BY label),
m AS (SELECT p.pattern, p.length, n.label, n.a, coalesce(h.c, 0)::DOUBLE AS c FROM (SELECT DISTINCT pattern, length FROM hit) p CROSS JOIN n
  LEFT JOIN (SELECT pattern, label, count(*) AS c FROM hit GROUP BY 1, 2) h ON h.pattern = p.pattern AND h.label = n.label),
gains AS (SELECT pattern, length, sum(c)::BIGINT AS support, ({xl("sum(a)")} - {sxl("a")} - {xl("sum(c)")} + {sxl("c")} - {xl("sum(a - c)")} + {sxl("(a - c)")}) / ln(2) / sum(a) AS gain FROM m GROUP BY 1, 2)"""


def _gains(spark, d):
    seqs = X.event_sequences(spark, d)
    ids = patterns.id_list(seqs)
    one = ids.select(F.col("item").alias("pattern"), F.lit(1).alias("length"), "sid")
    two = patterns.s_step(ids, ids, 2).select(F.concat("item", F.lit(">"), "item2").alias("pattern"), F.lit(2).alias("length"), "sid")
    hit = one.unionByName(two).distinct().join(seqs.select("sid", "label"), "sid").groupBy("pattern", "length", "label").agg(F.count("*").alias("n"))
    sizes = seqs.groupBy("label").agg(F.count("*").alias("n"))
    return patterns.match_gain(hit, ["pattern", "length"], sizes, splits.class_order(seqs, "label"))


@query(f"{GAINS} SELECT pattern, support, round(gain, 9) AS gain FROM gains")
def pattern_infogain(spark, d):
    return _gains(spark, d).select("pattern", "support", r9("gain"))


@query(
    f"{GAINS}, b AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY -round(gain, 12), pattern) AS rn FROM gains),"
    " s AS (SELECT pattern, length, gain, 0.75 * (1 - gain / max(gain) OVER ()) + 0.25 * length / max(length) OVER () AS score FROM b WHERE rn = 1)"
    " SELECT pattern, CAST(length AS INTEGER) AS length, round(gain, 9) AS gain, round(score, 9) AS score FROM s ORDER BY round(score, 12), length, pattern LIMIT 1"
)
def best_pattern_tradeoff(spark, d):
    best = F.min(F.struct((-F.round("gain", 12)).alias("g"), "pattern", "gain"))
    b = _gains(spark, d).groupBy("length").agg(best.alias("b")).select("length", "b.pattern", "b.gain")
    top = b.agg(F.max("gain").alias("top"), F.max("length").alias("longest"))
    s = b.crossJoin(F.broadcast(top)).withColumn("score", 0.75 * (1 - F.col("gain") / F.col("top")) + 0.25 * F.col("length") / F.col("longest"))
    return s.orderBy(F.round("score", 12), "length", "pattern").limit(1).select("pattern", "length", r9("gain"), r9("score"))


@query()
def mined_patterns(spark, d):
    found = patterns.mine(X.event_sequences(spark, d), support=0.04, gap=2, longest=3)
    return spark.createDataFrame([(m.text(), m.length, m.support, float(round(m.gain, 9))) for m in found], "pattern string, length int, support long, gain double")


def _step_sql(before: str, length: int) -> str:
    """Places of patterns of one more item than those of the CTE ``before``: in a later itemset, or in the same."""
    return (
        f"SELECT e.pattern || '>' || y.item AS pattern, {length} AS length, e.sid, e.label, y.tid, y.item FROM {before} e JOIN ids y ON e.sid = y.sid AND y.tid > e.tid AND y.tid - e.tid <= 2"
        f" UNION SELECT e.pattern || ',' || y.item, {length}, e.sid, e.label, y.tid, y.item FROM {before} e JOIN ids y ON e.sid = y.sid AND y.tid = e.tid AND y.item > e.item"
    )


@query(
    f"""{SEQS}, e1 AS (SELECT DISTINCT item AS pattern, 1 AS length, sid, label, tid, item FROM ids), e2 AS ({_step_sql("e1", 2)}), e3 AS ({_step_sql("e2", 3)}),
hit AS (SELECT pattern, length, label, count(DISTINCT sid) AS c FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) GROUP BY 1, 2, 3),
n AS (SELECT label, count(*)::DOUBLE AS a FROM sq GROUP BY label),
m AS (SELECT p.pattern, p.length, n.label, n.a, coalesce(h.c, 0)::DOUBLE AS c FROM (SELECT DISTINCT pattern, length FROM hit) p CROSS JOIN n LEFT JOIN hit h ON h.pattern = p.pattern AND h.label = n.label),
gains AS (SELECT pattern, length, sum(c)::BIGINT AS support, ({xl("sum(a)")} - {sxl("a")} - {xl("sum(c)")} + {sxl("c")} - {xl("sum(a - c)")} + {sxl("(a - c)")}) / ln(2) / sum(a) AS gain FROM m GROUP BY 1, 2)
SELECT pattern, CAST(length AS INTEGER) AS length, support, round(gain, 9) AS gain FROM gains WHERE length = 1 OR support >= greatest(1, ceil(0.04 * (SELECT count(*) FROM sq)))"""
)
def frequent_patterns(spark, d):
    found = patterns.mine(X.event_sequences(spark, d), support=0.04, gap=2, longest=3, generators=False)
    return spark.createDataFrame([(m.text(), m.length, m.support, float(round(m.gain, 9))) for m in found], "pattern string, length int, support long, gain double")


# -- 4. series

SHAPELET = "SELECT list_transform(embedding[9:24], lambda x: x::DOUBLE) AS s FROM embeddings WHERE vec_id = 38"
DIST = "floor(least(sqrt(list_min(list_transform(range(0, len({a}) - len({b}) + 1), lambda o: list_sum(list_transform(range(1, len({b}) + 1), lambda k: power({a}[o + k] - {b}[k], 2)))))) * 1e5, 2147483647)) / 1e5"
SERIES = "SELECT vec_id AS sid, label::VARCHAR AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"


def _shapelet(spark, d):
    return X.embedding_series(spark, d).where("sid = 38").select(F.lit(0).cast("bigint").alias("cand"), F.slice("series", 9, 16).alias("shapelet"))


@query(f"WITH c AS ({SHAPELET}), x AS ({SERIES}) SELECT sid, {DIST.format(a='e', b='s')} AS distance FROM x CROSS JOIN c")
def subsequence_distance(spark, d):
    return shapelets.distances(X.embedding_series(spark, d), _shapelet(spark, d)).select("sid", F.col("value").alias("distance"))


@query(
    f"WITH c AS ({SHAPELET}), x AS (SELECT sid, e[1:8] AS e FROM ({SERIES}) y) SELECT sid, {DIST.format(a='s', b='e')} AS swapped, "
    "floor(least(sqrt(list_sum(list_transform(range(1, 17), lambda k: power((CASE WHEN k <= 8 THEN e[k] ELSE 0 END) - s[k], 2)))) * 1e5, 2147483647)) / 1e5 AS padded FROM x CROSS JOIN c"
)
def distance_swap_vs_pad(spark, d):
    short = X.embedding_series(spark, d).withColumn("series", F.slice("series", 1, 8)).crossJoin(F.broadcast(_shapelet(spark, d)))
    return short.select("sid", TS.distance(F.col("series"), F.col("shapelet")).alias("swapped"), TS.distance_padded(F.col("series"), F.col("shapelet")).alias("padded"))


ONE_SHAPELET = f"SELECT 0 AS attr, {DIST.format(a='e', b='s')} AS v, label AS c FROM ({SERIES}) x CROSS JOIN ({SHAPELET}) c"
MEANS = f"SELECT label, list(m ORDER BY i) AS s FROM (SELECT label, i, round(avg(e[i]), 6) AS m FROM ({SERIES}) y CROSS JOIN range(25, 41) t(i) GROUP BY label, i) z GROUP BY label"
CANDIDATES = f"SELECT s.label AS attr, {DIST.format(a='e', b='s')} AS v, x.label AS c FROM ({SERIES}) x CROSS JOIN ({MEANS}) s"


@query(f"{scan_sql(ONE_SHAPELET)} {BEST} SELECT round(threshold, 9) AS threshold, lower, candidates, round(raw_gain, 9) AS raw_gain, round(gain, 9) AS gain FROM best")
def shapelet_threshold(spark, d):
    return shapelets.score_candidates(X.embedding_series(spark, d), _shapelet(spark, d), use_mdl=True).select(r9("threshold"), "lower", "candidates", r9("raw_gain"), r9("gain"))


@query(f"{scan_sql(CANDIDATES)} {BEST} SELECT attr AS cand, lower, round(raw_gain, 9) AS gain, row_number() OVER (ORDER BY -round(raw_gain, 12), attr) AS place FROM best")
def shapelet_candidates_rank(spark, d):
    from pyspark.sql import Window

    s = X.embedding_series(spark, d)
    mean = F.array(*[F.round(F.avg(F.get("series", F.lit(i))), 6) for i in range(24, 40)])  # the middle of each class's mean series
    cands = s.groupBy("label").agg(mean.alias("shapelet")).withColumnRenamed("label", "cand")
    place = F.row_number().over(Window.orderBy(-F.round("raw_gain", 12), "cand")).cast("bigint")  # one row a candidate
    return shapelets.score_candidates(s, cands).select("cand", "lower", r9("raw_gain", "gain"), place.alias("place"))


@query("SELECT user_id AS sid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS place, round(v, 6) AS v FROM (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)")
def series_assemble(spark, d):
    return X.daily_series(spark, d).select("sid", F.posexplode("series").alias("p", "x")).select("sid", (F.col("p") + 1).cast("int").alias("place"), F.round("x", 6).alias("v"))


#: The last row of the warping table of the window of ``e`` at ``o`` (rows: its values) against ``s`` (columns, the first one outside).
WARPED = """list_reduce(list_concat([list_concat([0::DOUBLE], list_transform(s, lambda z: 'inf'::DOUBLE))], list_transform(e[o:o + len(s) - 1], lambda z: [z])),
  lambda r, v: list_reduce(list_concat([['inf'::DOUBLE]], list_transform(range(1, len(s) + 1), lambda k: [k::DOUBLE])),
    lambda acc, j: list_append(acc, power(v[1] - s[j[1]::INT], 2) + least(acc[len(acc)], r[j[1]::INT], r[j[1]::INT + 1]))))"""


@query(
    f"""WITH c AS ({SHAPELET}), x AS ({SERIES}), w AS (SELECT sid, s, e, unnest(range(1, len(e) - len(s) + 2)) AS o FROM x CROSS JOIN c),
p AS (SELECT sid, {WARPED} AS r FROM w) SELECT sid, floor(least(sqrt(min(r[len(r)])) * 1e5, 2147483647)) / 1e5 AS distance FROM p GROUP BY sid"""
)
def dtw_optional(spark, d):
    shapelet = [float(v) for v in _shapelet(spark, d).first()["shapelet"]]
    return X.embedding_series(spark, d).select("sid", TS.dtw_udf(shapelet)("series").alias("distance"))


@query()
def compression_ratio(spark, d):
    return X.embedding_series(spark, d).select("sid", TS.compression_udf()("series").alias("ratio"))


@query()
def shapelet_search(spark, d):
    f = shapelets.search(X.embedding_series(spark, d), population=20, evaluations=60)
    rows = [] if f is None else [([float(v) for v in f.shapelet], float(f.gain), float(f.ratio), float(f.threshold))]
    return spark.createDataFrame(rows, "shapelet array<double>, gain double, ratio double, threshold double")


# -- 5. two objectives

POINTS = 'SELECT p_type AS "group", p_partkey AS id, -p_size::DOUBLE AS x, round(p_retailprice, 2) AS y FROM part'


@query(f'WITH p AS ({POINTS}) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q."group" = p."group" AND q.x <= p.x AND q.y <= p.y AND (q.x < p.x OR q.y < p.y))')
def pareto_front(spark, d):
    return pareto.front(X.part_points(spark, d))


CROWD = " + ".join(
    f"CASE WHEN max({v}) OVER g > min({v}) OVER g THEN (lead({v}) OVER o{v} - lag({v}) OVER o{v}) / (max({v}) OVER g - min({v}) OVER g) WHEN lead({v}) OVER o{v} IS NOT NULL AND lag({v}) OVER o{v} IS NOT NULL THEN 0 END" for v in ("x", "y")
)
WINDOWS = 'WINDOW g AS (PARTITION BY {p}), ox AS (PARTITION BY {p} ORDER BY x, id), oy AS (PARTITION BY {p} ORDER BY y, id)'


@query(f'WITH p AS ({POINTS}) SELECT "group", id, round({CROWD}, 9) AS crowd FROM p {WINDOWS.format(p=chr(34) + "group" + chr(34))}')
def crowding_distance(spark, d):
    return pareto.crowding(X.part_points(spark, d)).select("group", "id", r9("crowd"))


@query(
    f"""WITH RECURSIVE p AS ({POINTS}), c("group", id, x, y, k) AS (SELECT "group", id, x, y, 0 FROM p
  UNION SELECT p."group", p.id, p.x, p.y, c.k + 1 FROM c JOIN p ON p."group" = c."group" AND c.x <= p.x AND c.y <= p.y AND (c.x < p.x OR c.y < p.y)),
f AS (SELECT "group", id, x, y, max(k) AS front FROM c GROUP BY 1, 2, 3, 4),
w AS (SELECT "group", id, front, round({CROWD}, 9) AS crowd FROM f {WINDOWS.format(p='"group", front')}),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY front, crowd DESC NULLS FIRST, id) AS place FROM w)
SELECT "group", id, CAST(front AS INTEGER) AS front, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20"""
)
def nsga_truncate(spark, d):
    ranked = pareto.crowding(pareto.fronts(X.part_points(spark, d), 20), ("group", "front")).withColumn("crowd", F.round("crowd", 9))
    return pareto.survivors(ranked, 20).select("group", "id", "front", "place")


@query(
    f"""WITH p AS ({POINTS}), s AS (SELECT *, CASE WHEN -x <= 0 THEN NULL ELSE 0.25 * y / max(y) OVER g + 0.75 * (1 - (-x) / max(-x) OVER g) END AS score FROM p WINDOW g AS (PARTITION BY "group")),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(score, 12) NULLS LAST, y, id) AS rn FROM s) SELECT "group", id, x, y, round(score, 9) AS score FROM r WHERE rn = 1"""
)
def knee_select(spark, d):
    return pareto.knee(X.part_points(spark, d), 0.75).select("group", "id", "x", "y", r9("score"))


# -- 6. trees


def sample_tree() -> Tree:
    """Three splits, as if fitted."""
    n = [
        Node(0, None, None, [30.0, 40.0, 30.0], Split("threshold", "l_quantity", threshold=25.0), [60.0, 40.0], [1, 2]),
        Node(1, 0, 0, [10.0, 40.0, 10.0], Split("threshold", "l_discount", threshold=0.05), [45.0, 15.0], [3, 4]),
        Node(2, 0, 1, [20.0, 0.0, 20.0], Split("value", "l_linestatus", ("O",)), [10.0, 30.0], [5, 6]),
        Node(3, 1, 0, [5.0, 36.0, 4.0]), Node(4, 1, 1, [5.0, 4.0, 6.0]), Node(5, 2, 0, [0.0, 0.0, 0.0]), Node(6, 2, 1, [20.0, 0.0, 20.0]),
    ]
    kinds = {"l_quantity": "numeric", "l_discount": "numeric", "l_linestatus": "nominal"}
    return Tree(FLAGS, kinds, {x.id: x for x in n}, Options())


LEAF = "CASE WHEN l_quantity - 25 < 1e-6 THEN (CASE WHEN l_discount - 0.05 < 1e-6 THEN 3 ELSE 4 END) WHEN l_linestatus = 'O' THEN 5 ELSE 6 END"


@query(f"SELECT leaf, CASE leaf WHEN 3 THEN 'N' WHEN 4 THEN 'R' ELSE 'A' END AS prediction, label, count(*) AS n FROM (SELECT CAST({LEAF} AS INTEGER) AS leaf, l_returnflag AS label FROM lineitem) GROUP BY 1, 2, 3")
def tree_score_case(spark, d):
    t = sample_tree()
    rows = score.with_leaf(score.predict(X.table(spark, d, "lineitem"), t), t)
    return rows.groupBy("leaf", "prediction", F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))


REACH = f"""WITH r AS (SELECT l_linenumber, l_returnflag, CASE WHEN l_quantity IS NULL THEN 0.6 WHEN l_quantity - 25 < 1e-6 THEN 1.0 ELSE 0.0 END AS a,
  CASE WHEN l_discount IS NULL THEN 0.75 WHEN l_discount - 0.05 < 1e-6 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN l_linestatus IS NULL THEN 0.25 WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS c FROM ({GAPS}) x),
w AS (SELECT l_linenumber, l_returnflag, unnest([{{'node': 0, 'w': 1.0}}, {{'node': 1, 'w': a}}, {{'node': 2, 'w': 1 - a}}, {{'node': 3, 'w': a * b}}, {{'node': 4, 'w': a * (1 - b)}}, {{'node': 5, 'w': (1 - a) * c}}, {{'node': 6, 'w': (1 - a) * (1 - c)}}]) AS s FROM r)"""


@query(
    f"""{REACH}, q AS (SELECT * FROM (VALUES (3, 'A', 5 / 45.0), (3, 'N', 36 / 45.0), (3, 'R', 4 / 45.0), (4, 'A', 5 / 15.0), (4, 'N', 4 / 15.0), (4, 'R', 6 / 15.0), (5, 'A', 0.5), (5, 'N', 0.0), (5, 'R', 0.5), (6, 'A', 0.5), (6, 'N', 0.0), (6, 'R', 0.5)) v(node, label, p))
SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, q.label, round(sum(s.w::DOUBLE * p::DOUBLE), 5) AS p FROM w JOIN q ON q.node = s.node GROUP BY 1, 2"""
)
def tree_proba_missing(spark, d):
    rows = score.predict_proba(X.lines_with_gaps(spark, d), sample_tree())
    return rows.select("l_linenumber", F.explode("probability").alias("label", "p")).groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber"), "label").agg(F.round(F.sum("p"), 5).alias("p"))


@query(f"{REACH} SELECT CAST(s.node AS INTEGER) AS node, l_returnflag AS label, round(sum(s.w)::DOUBLE, 5) AS w FROM w WHERE s.w > 0 GROUP BY 1, 2")
def membership_values(spark, d):
    m = score.membership(X.lines_with_gaps(spark, d), sample_tree(), ["l_returnflag"])
    return m.groupBy("node", F.col("l_returnflag").alias("label")).agg(F.round(F.sum("w"), 5).alias("w"))


BAGS = f"SELECT attr, v AS bag, sum(n) AS n, sum(n) - max(n) AS e FROM (SELECT attr, v, c, count(*)::DOUBLE AS n FROM ({NOMINAL_ROWS}) r WHERE v IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"
Z = "0.6744897501960817"


@query(
    f"""WITH b AS ({BAGS}), f AS (SELECT *, (e + 0.5) / n AS f FROM b)
SELECT attr, bag, n, e, round(CASE WHEN e = 0 THEN n * (1 - power(0.25, 1 / n)) WHEN e + 0.5 >= n THEN greatest(n - e, 0)
  ELSE (f + {Z} * {Z} / (2 * n) + {Z} * sqrt(f / n - f * f / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n) * n - e END, 6) AS added FROM f"""
)
def pessimistic_errors(spark, d):
    t = splits.contingency(_nominal(spark, d).where("value is not null"), FLAGS, ATTR)
    c = splits.counts("c", 3)
    b = t.select("attr", F.col("value").alias("bag"), C.total(c).alias("n"), (C.total(c) - F.greatest(*c)).alias("e"))
    return b.select("attr", "bag", "n", "e", F.round(C.add_errs_col(F.col("n"), F.col("e"), 0.25), 6).alias("added"))


@query(
    f"""WITH b AS (SELECT attr, sum(e) AS below FROM ({BAGS}) GROUP BY attr), w AS (SELECT attr, sum(n) - max(n) AS own FROM (SELECT attr, c, count(*)::DOUBLE AS n FROM ({NOMINAL_ROWS}) r WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY attr)
SELECT attr, own, below, below >= own - 1e-3 AS collapses FROM b JOIN w USING (attr)"""
)
def collapse_decision(spark, d):
    t = splits.contingency(_nominal(spark, d).where("value is not null"), FLAGS, ATTR)
    c = splits.counts("c", 3)
    sums = [F.sum(f"c{i}") for i in range(3)]
    a = t.groupBy("attr").agg((C.total(sums) - F.greatest(*sums)).alias("own"), F.sum(C.total(c) - F.greatest(*c)).alias("below"))
    return a.withColumn("collapses", F.col("below") >= F.col("own") - 1e-3)


@query(
    f"""WITH r AS (SELECT p_brand AS bag, l_returnflag AS c, (l_orderkey * 7 + l_linenumber) % 3 AS fold FROM ({LINES}) x WHERE p_brand IS NOT NULL),
g AS (SELECT bag, c, count(*) AS n FROM r WHERE fold < 2 GROUP BY 1, 2), m AS (SELECT bag, c FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY n DESC, c) AS rn FROM g) WHERE rn = 1)
SELECT r.bag, count(*) AS held, count(*) FILTER (WHERE r.c <> m.c) AS errors FROM r JOIN m ON m.bag = r.bag WHERE fold = 2 GROUP BY r.bag"""
)
def rep_fold_errors(spark, d):
    r = X.lines(spark, d).where("p_brand is not null").select(F.col("p_brand").alias("bag"), F.col("l_returnflag").alias("c"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 3).alias("fold"))
    g = r.where("fold < 2").groupBy("bag", "c").agg(F.count("*").alias("n"))
    m = g.groupBy("bag").agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("m")).select("bag", F.col("m.c").alias("most"))
    return r.where("fold = 2").join(m, "bag").groupBy("bag").agg(F.count("*").alias("held"), F.count_if(F.col("c") != F.col("most")).alias("errors"))


def _columns(spark, d):
    return X.lines(spark, d).select("l_returnflag", *X.NUMERIC, *X.NOMINAL)


@query()
def fit_tree_nodes(spark, d):
    return fit(_columns(spark, d), "l_returnflag", options=Options(unpruned=True, collapse=False, max_depth=3)).table(spark)


@query()
def fit_tree_binary_pruned(spark, d):
    return fit(_columns(spark, d), "l_returnflag", options=Options(binary=True, max_depth=3)).table(spark)


@query()
def fit_tree_reduced_error(spark, d):
    return fit(X.marked_documents(spark, d).drop("doc_id"), "quality", options=Options(reduced_error=True, max_depth=4)).table(spark)


@query()
def fit_tree_sequences(spark, d):
    rows = X.event_sequences(spark, d).select("label", F.col("text").alias("SEQ_events"))
    return fit(rows, "label", options=Options(max_depth=1, support=0.2, longest=2, unpruned=True, collapse=False)).table(spark)


@query()
def fit_tree_series(spark, d):
    rows = X.embedding_series(spark, d).select("label", F.col("series").alias("TS_emb"))
    return fit(rows, "label", options=Options(max_depth=1, population=10, evaluations=20, unpruned=True, collapse=False)).table(spark)


@query()
def tree_scores(spark, d):
    df = _columns(spark, d)
    tree = fit(df, "l_returnflag", options=Options(unpruned=True, collapse=False, max_depth=2))
    rows = score.predict(normalise(df, "l_returnflag", infer_kinds(df, "l_returnflag")), tree)
    return rows.groupBy("l_returnflag", "prediction").agg(F.count("*").alias("n"))
