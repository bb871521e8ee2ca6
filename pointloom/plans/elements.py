"""Queries of the evaluator, of proposals and of element tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import elements as M
from pointloom.operators import grid as G
from pointloom.operators import proposals as P
from pointloom.operators import quality as Q
from pointloom.operators.cloud import num
from pointloom.operators.evidence import micro
from pointloom.plans.registry import query
from pointloom.sources.tables import CLOUD_SQL, orders_cloud, read

c, lit = F.col, F.lit

# --- votes and labels ------------------------------------------------------------------------------

VOTES_SQL = "votes AS (SELECT user_id AS row, event_id % 6 - 1 AS label, value AS score FROM events)"
MAJORITY_SQL = "mj AS (SELECT row, label, n AS votes, best AS score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY n DESC, label) AS k FROM (SELECT row, label, count(*) AS n, max(score) AS best FROM votes WHERE label >= 0 GROUP BY ALL)) WHERE k = 1)"


def votes(spark, d):
    return read(spark, d, "events").select(c("user_id").alias("row"), (c("event_id") % 6 - 1).alias("label"), c("value").alias("score"))


@query(f"WITH {VOTES_SQL}, {MAJORITY_SQL} SELECT row, label, votes, score FROM mj")
def majority_vote(spark, d):
    """Most frequent label per row, lowest on ties."""
    return P.majority(votes(spark, d))


@query(f"WITH {VOTES_SQL}, {MAJORITY_SQL}, r AS (SELECT c_custkey AS row FROM customer) SELECT row, coalesce(label, -1) AS label, coalesce(score, 0e0) AS score FROM r LEFT JOIN mj USING (row)")
def labels_with_unknown(spark, d):
    rows = read(spark, d, "customer").select(c("c_custkey").alias("row"))
    return P.with_unknown(rows, P.majority(votes(spark, d))).select("row", c("label").cast("long").alias("label"), "score")


@query(f"""WITH {CLOUD_SQL}, t AS (SELECT rid, x, y, unnest(generate_series(CAST(floor((x - 0.4e0) / 2e0) AS BIGINT), CAST(floor((x + 0.4e0) / 2e0) AS BIGINT))) AS tx FROM cloud), u AS (SELECT *, unnest(generate_series(CAST(floor((y - 0.4e0) / 2e0) AS BIGINT), CAST(floor((y + 0.4e0) / 2e0) AS BIGINT))) AS ty FROM t),
votes AS (SELECT rid AS row, (rid * 7 + (tx + 5) * 3 + ty + 5) % 4 - 1 AS label, ((rid + tx + 5) % 100) / 100e0 AS score FROM u), {MAJORITY_SQL} SELECT row, label, votes, score FROM mj""")
def tile_votes(spark, d):
    """Points vote once in each tile whose halo holds them."""
    t = G.tiles_with_halo(orders_cloud(spark, d), 2.0, 0.4)
    v = t.select(c("rid").alias("row"), ((c("rid") * 7 + (c("tx") + 5) * 3 + c("ty") + 5) % 4 - 1).alias("label"), (((c("rid") + c("tx") + 5) % 100) / num(100)).alias("score"))
    return P.majority(v)


@query(f"""WITH {CLOUD_SQL}, s AS (SELECT s_suppkey % 8 AS taxonomy, ((s_suppkey * 7) % 100) / 10e0 AS x0, ((s_suppkey * 13) % 80) / 10e0 AS y0 FROM supplier)
SELECT rid, min(taxonomy) AS label FROM cloud JOIN s ON x BETWEEN x0 AND x0 + 1.1e0 AND y BETWEEN y0 AND y0 + 0.9e0 GROUP BY rid""")
def lowest_label(spark, d):
    """Lowest taxonomy among the supports that contain a point, by an equi-join on cells."""
    k = c("s_suppkey")
    s = read(spark, d, "supplier").select((k % 8).alias("taxonomy"), (((k * 7) % 100) / num(10)).alias("x0"), (((k * 13) % 80) / num(10)).alias("y0"))
    s = s.withColumn("cx", F.explode(F.sequence(G.cell(c("x0"), 1.0), G.cell(c("x0") + num(1.1), 1.0)))).withColumn("cy", F.explode(F.sequence(G.cell(c("y0"), 1.0), G.cell(c("y0") + num(0.9), 1.0))))
    p = orders_cloud(spark, d).withColumn("cx", G.cell(c("x"), 1.0)).withColumn("cy", G.cell(c("y"), 1.0))
    return P.lowest_label(p.join(G.small(s), ["cx", "cy"]).where(c("x").between(c("x0"), c("x0") + num(1.1)) & c("y").between(c("y0"), c("y0") + num(0.9))))


REGION_SQL = "mb AS (SELECT user_id % 60 AS region, CASE WHEN event_id % 3 = 0 THEN event_id % 4 - 1 ELSE user_id % 4 END AS label FROM events)"
CLAIM_SQL = "n AS (SELECT region, label, count(*) AS n FROM mb WHERE label >= 0 GROUP BY ALL), k AS (SELECT region, CAST(sum(n) AS BIGINT) AS known FROM n GROUP BY region), cl AS (SELECT region, label, n, known FROM n JOIN k USING (region) WHERE n >= 6 AND n >= 0.6e0 * known)"


def claims(spark, d):
    m = read(spark, d, "events").select((c("user_id") % 60).alias("region"), F.when(c("event_id") % 3 == 0, c("event_id") % 4 - 1).otherwise(c("user_id") % 4).alias("label"))
    return P.region_claims(m)


@query(f"WITH {REGION_SQL}, {CLAIM_SQL} SELECT region, label, n, known FROM cl")
def region_claims(spark, d):
    return claims(spark, d)


@query(f"WITH {REGION_SQL}, {CLAIM_SQL} SELECT region % 9 AS grp, count(*) AS members, CASE WHEN count(DISTINCT label) = 1 THEN 'c' || min(label) ELSE 'conflicting' END AS class FROM cl GROUP BY 1")
def fused_candidates(spark, d):
    return P.fused(claims(spark, d).select((c("region") % 9).alias("grp"), F.concat(lit("c"), c("label").cast("string")).alias("claim")))


@query()
def column_digest(spark, d):
    """Order-free content digest; Spark's own row hash, so rows only."""
    return P.column_digest(orders_cloud(spark, d), "rid", "x", "y", "z")


@query("""WITH l AS (SELECT event_id AS rid, event_id % 9 - 2 AS label, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 9 = 1 AND event_id % 2 = 0 THEN 0e0 ELSE (event_id % 103) / 100e0 END AS score FROM events)
SELECT rid, rule FROM (SELECT rid, CASE WHEN score IS NULL THEN 'missing' WHEN label < -1 OR label > 5 THEN 'label' WHEN score < 0 OR score > 1 THEN 'score' WHEN label = -1 AND score <> 0 THEN 'unknown_score' END AS rule FROM l) WHERE rule IS NOT NULL""")
def label_violations(spark, d):
    e = c("event_id")
    score = F.when(e % 50 == 0, None).when((e % 9 == 1) & (e % 2 == 0), num(0)).otherwise((e % 103) / num(100))
    return P.label_violations(read(spark, d, "events").select(e.alias("rid"), (e % 9 - 2).alias("label"), score.alias("score")), 5).select("rid", "rule")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 60 - 2 < 0 OR (p_partkey * 3) % 50 - 1 < 0 OR p_partkey % 60 - 2 + p_size % 7 > 59 OR (p_partkey * 3) % 50 + 3 > 50 OR p_size % 7 = 0")
def detection_violations(spark, d):
    k, s = c("p_partkey"), c("p_size").cast("long")
    boxes = read(spark, d, "part").select(k.alias("id"), (k % 60 - 2).alias("x0"), (k % 60 - 2 + s % 7).alias("x1"), ((k * 3) % 50 - 1).alias("y0"), ((k * 3) % 50 + 3).alias("y1"), lit(59).alias("width"), lit(50).alias("height"))
    return P.detection_violations(boxes).select("id")


# --- evaluation --------------------------------------------------------------------------------------

SAMPLES_SQL = "t AS (SELECT o_orderkey AS k, o_custkey % 4 AS truth FROM orders), p AS (SELECT o_orderkey AS k, (o_custkey + CAST(o_orderkey % 11 = 0 AS INT)) % 4 AS predicted FROM orders WHERE o_orderkey % 5 <> 0), j AS (SELECT * FROM t LEFT JOIN p USING (k))"
CONFUSION_SQL = "cf AS (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (truth <> class AND predicted = class) AS fp, count(*) FILTER (truth = class AND predicted IS DISTINCT FROM class) AS fn FROM j, (SELECT unnest([0, 1, 2, 3])::BIGINT AS class) GROUP BY class)"


def samples(spark, d):
    o = read(spark, d, "orders")
    t = o.select(c("o_orderkey").alias("k"), (c("o_custkey") % 4).alias("truth"))
    p = o.where("o_orderkey % 5 <> 0").select(c("o_orderkey").alias("k"), ((c("o_custkey") + F.when(c("o_orderkey") % 11 == 0, 1).otherwise(0)) % 4).alias("predicted"))
    return Q.joined_samples(t, p, ["k"])


@query(f"WITH {SAMPLES_SQL}, {CONFUSION_SQL} SELECT class, tp, fp, fn FROM cf")
def sample_confusion(spark, d):
    """Truth against predictions by record; a missing prediction is a miss."""
    return Q.confusion(samples(spark, d), range(4)).withColumn("class", c("class").cast("long"))


@query(f"WITH {SAMPLES_SQL}, {CONFUSION_SQL} SELECT class, tp, fp, fn, tp::DOUBLE / nullif(tp + fp, 0)::DOUBLE AS precision, tp::DOUBLE / nullif(tp + fn, 0)::DOUBLE AS recall, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, tp::DOUBLE / nullif(tp + fp + fn, 0)::DOUBLE AS iou FROM cf")
def class_scores(spark, d):
    return Q.scores(Q.confusion(samples(spark, d), range(4)).withColumn("class", c("class").cast("long")))


@query("SELECT class, count(*) FILTER (quality = class AND toxic = class) AS tp, count(*) FILTER (quality <> class AND toxic = class) AS fp, count(*) FILTER (quality = class AND toxic <> class) AS fn FROM labels, (SELECT unnest([0, 1])::INTEGER AS class) GROUP BY class")
def label_confusion(spark, d):
    return Q.confusion(read(spark, d, "labels").select(c("quality").alias("truth"), c("toxic").alias("predicted")), range(2))


@query("WITH w AS (SELECT c_custkey AS id FROM customer), g AS (SELECT DISTINCT o_custkey + 7 AS id FROM orders) SELECT id, 'missing' AS side FROM w ANTI JOIN g USING (id) UNION SELECT id, 'extra' FROM g ANTI JOIN w USING (id)")
def missing_extra_ids(spark, d):
    wanted = read(spark, d, "customer").select(c("c_custkey").alias("id"))
    return Q.id_differences(wanted, read(spark, d, "orders").select((c("o_custkey") + 7).alias("id")), "id")


@query("""WITH r AS (SELECT o_custkey % 40 AS element, o_orderkey AS rec FROM orders WHERE o_orderkey % 3 = 0), e AS (SELECT DISTINCT l_suppkey % 40 AS element, l_orderkey AS rec FROM lineitem), h AS (SELECT element, count(*) AS held FROM r SEMI JOIN e USING (element, rec) GROUP BY element)
SELECT element, count(*) AS required, coalesce(any_value(held), 0) AS held, coalesce(any_value(held), 0)::DOUBLE / count(*)::DOUBLE AS share FROM r LEFT JOIN h USING (element) GROUP BY element""")
def evidence_retention(spark, d):
    """Required records that an element's own evidence still holds."""
    r = read(spark, d, "orders").where("o_orderkey % 3 = 0").select((c("o_custkey") % 40).alias("element"), c("o_orderkey").alias("rec"))
    e = read(spark, d, "lineitem").select((c("l_suppkey") % 40).alias("element"), c("l_orderkey").alias("rec"))
    return Q.retention(r, e, "element", ["rec"])


GATES_SQL = """mt AS (SELECT c_nationkey AS "case", 'count' AS metric, count(*)::DOUBLE AS value FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1 UNION ALL SELECT c_nationkey, 'best', max(c_acctbal) FROM customer GROUP BY 1),
gt AS (SELECT n_nationkey AS "case", unnest(['count', 'best', 'absent']) AS metric, unnest(['>=', '<=', '==']) AS operator, unnest([55e0, 9900e0, 1e0]) AS bound FROM nation),
rs AS (SELECT "case", metric, coalesce(CASE operator WHEN '<=' THEN value <= bound WHEN '>=' THEN value >= bound ELSE value = bound END, false) AS passed FROM gt LEFT JOIN mt USING ("case", metric))"""


def gates(spark, d):
    cust = read(spark, d, "customer").withColumnRenamed("c_nationkey", "case")
    m = cust.where("case % 6 <> 0").groupBy("case").agg(F.count(lit(1)).cast("double").alias("value")).select("case", lit("count").alias("metric"), "value")
    m = m.unionByName(cust.groupBy("case").agg(F.max("c_acctbal").alias("value")).select("case", lit("best").alias("metric"), "value"))
    g = F.array(*[F.struct(lit(a).alias("metric"), lit(o).alias("operator"), num(b).alias("bound")) for a, o, b in (("count", ">=", 55), ("best", "<=", 9900), ("absent", "==", 1))])
    return m, read(spark, d, "nation").select(c("n_nationkey").alias("case"), F.explode(g).alias("g")).select("case", "g.*")


@query(f'WITH {GATES_SQL} SELECT "case", metric, passed FROM rs')
def gate_results(spark, d):
    """Gates over metric rows; a missing metric fails."""
    return Q.gate_results(*gates(spark, d)).select("case", "metric", "passed")


@query(f"""WITH {GATES_SQL}, cs AS (SELECT n_nationkey AS "case", n_regionkey < 2 AS required, n_nationkey % 4 = 0 AS held_out FROM nation), o AS (SELECT "case", bool_and(passed) AS ok FROM rs WHERE metric <> 'absent' GROUP BY 1)
SELECT coalesce(bool_or(held_out), false) AND coalesce(bool_and(coalesce(ok, false)), false) AS passed, count(*) AS required_cases FROM cs LEFT JOIN o USING ("case") WHERE required""")
def benchmark_verdict(spark, d):
    cases = read(spark, d, "nation").select(c("n_nationkey").alias("case"), (c("n_regionkey") < 2).alias("required"), (c("n_nationkey") % 4 == 0).alias("held_out"))
    return Q.benchmark_passes(cases, Q.gate_results(*gates(spark, d)).where("metric <> 'absent'"))


@query("""WITH b AS (SELECT c_nationkey AS k, count(*) AS before FROM customer WHERE c_nationkey <> 3 GROUP BY 1), a AS (SELECT s_nationkey AS k, count(*) AS after FROM supplier WHERE s_nationkey <> 5 GROUP BY 1)
SELECT k, before, after, CASE WHEN before IS NULL THEN 'after' WHEN after IS NULL THEN 'before' ELSE 'both' END AS side, after - before AS change FROM b FULL JOIN a USING (k)""")
def baseline_compare(spark, d):
    b = read(spark, d, "customer").where("c_nationkey <> 3").groupBy(c("c_nationkey").alias("k")).agg(F.count(lit(1)).alias("value"))
    a = read(spark, d, "supplier").where("s_nationkey <> 5").groupBy(c("s_nationkey").alias("k")).agg(F.count(lit(1)).alias("value"))
    return Q.compared(b, a, ["k"])


BOX_SQL = """tb AS (SELECT p_partkey AS id, p_size % 5 AS cls, ((p_partkey * 37) % 1000) / 10e0 AS x0, ((p_partkey * 53) % 800) / 10e0 AS y0, 1e0 + p_size % 4 AS w, 2e0 AS h FROM part), t AS (SELECT id, cls, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM tb),
p AS (SELECT id + 100000 AS id, cls, x0 + 0.25e0 AS x0, y0 - 0.125e0 AS y0, x1 + 0.25e0 AS x1, y1 + 0.25e0 AS y1 FROM t WHERE id % 7 <> 0)"""


def boxes(spark, d):
    k = c("p_partkey")
    x0, y0 = ((k * 37) % 1000) / num(10), ((k * 53) % 800) / num(10)
    t = read(spark, d, "part").select(k.alias("id"), (c("p_size") % 5).alias("cls"), x0.alias("x0"), y0.alias("y0"), (x0 + (num(1) + c("p_size") % 4)).alias("x1"), (y0 + num(2)).alias("y1"))
    p = t.where("id % 7 <> 0").select((c("id") + 100000).alias("id"), "cls", (c("x0") + num(0.25)).alias("x0"), (c("y0") - num(0.125)).alias("y0"), (c("x1") + num(0.25)).alias("x1"), (c("y1") + num(0.25)).alias("y1"))
    return t, p


IOU_SQL = "pr AS (SELECT cls, t.id AS truth_id, p.id AS pred_id, CASE WHEN least(t.x1, p.x1) > greatest(t.x0, p.x0) AND least(t.y1, p.y1) > greatest(t.y0, p.y0) THEN (least(t.x1, p.x1) - greatest(t.x0, p.x0)) * (least(t.y1, p.y1) - greatest(t.y0, p.y0)) ELSE 0e0 END AS i, (t.x1 - t.x0) * (t.y1 - t.y0) AS ta, (p.x1 - p.x0) * (p.y1 - p.y0) AS pa FROM t JOIN p USING (cls))"


@query(f"WITH {BOX_SQL}, {IOU_SQL} SELECT cls, truth_id, pred_id, CAST(round(i / (ta + pa - i) * 1e6) AS BIGINT) AS iou_micro FROM pr WHERE i / (ta + pa - i) >= 0.25e0")
def candidate_pairs(spark, d):
    """Truth and prediction of one class with enough overlap, by cells."""
    return Q.box_overlaps(*boxes(spark, d), 4.0, 0.25).select("cls", "truth_id", "pred_id", micro(c("iou")).alias("iou_micro"))


@query()
def instance_match(spark, d):
    """One-to-one matches: most pairs, then least cost. An assignment problem, so rows only."""
    return Q.matched_boxes(*boxes(spark, d), 4.0, 0.25)


@query()
def instance_counts(spark, d):
    t, p = boxes(spark, d)
    return Q.instance_counts(t, p, Q.matched_boxes(t, p, 4.0, 0.25))


# --- elements ------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT p_partkey AS id, ((p_partkey * 7) % 60) * 0.1e0 - 0.2e0 + CASE WHEN p_partkey % 3 = 0 THEN 4e-7 ELSE 0e0 END AS off, 0.4e0 + (p_size % 10) * 0.1e0 AS w, 5e0 AS len FROM part), e AS (SELECT *, greatest(-off, off + w - len, 0e0) AS ex FROM o)
SELECT id, CASE WHEN ex <= 0 THEN 'kept' WHEN ex <= 1e-6 THEN 'clamped' ELSE 'review' END AS action, CAST(round(CASE WHEN ex > 0 AND ex <= 1e-6 THEN greatest(0e0, least(off, len - w)) ELSE off END * 1e9) AS BIGINT) AS offset_nano, CAST(round(ex * 1e9) AS BIGINT) AS excess_nano FROM e""")
def opening_clamp(spark, d):
    """Tiny overhangs are clamped, larger ones go to review with their excess."""
    k = c("p_partkey")
    off = ((k * 7) % 60) * num(0.1) - num(0.2) + F.when(k % 3 == 0, num(4e-7)).otherwise(num(0))
    rows = read(spark, d, "part").select(k.alias("id"), off.alias("off"), (num(0.4) + (c("p_size") % 10) * num(0.1)).alias("w"))
    action, offset, excess = M.clamped(c("off"), c("w"), num(5))
    return rows.select("id", action.alias("action"), micro(offset, 1e9).alias("offset_nano"), micro(excess, 1e9).alias("excess_nano"))


WALL_SQL = "w AS (SELECT s_suppkey AS wall, s_nationkey AS storey, (s_suppkey % 30) * 0.1e0 AS axis, 4e0 + s_suppkey % 3 AS length, s_suppkey % 2 = 0 AS paired FROM supplier), o AS (SELECT c_custkey AS opening, c_nationkey AS storey, ((c_custkey * 7) % 300) / 100e0 AS centre, ((c_custkey * 3) % 70) / 10e0 AS along, 0.9e0 AS width FROM customer)"


@query(f"""WITH {WALL_SQL}, f AS (SELECT *, abs(centre - axis) AS distance FROM o JOIN w USING (storey) WHERE abs(centre - axis) <= 0.5e0 AND along - width / 2 >= -1e-6 AND along + width / 2 <= length + 1e-6)
SELECT opening, wall, CAST(round(distance * 1e6) AS BIGINT) AS distance_micro FROM (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY distance, NOT paired, abs(along - length / 2), wall) AS k FROM f) WHERE k = 1""")
def opening_rehost(spark, d):
    """Best final host of each opening."""
    k, s = c("c_custkey"), c("s_suppkey")
    o = read(spark, d, "customer").select(k.alias("opening"), c("c_nationkey").alias("storey"), (((k * 7) % 300) / num(100)).alias("centre"), (((k * 3) % 70) / num(10)).alias("along"), num(0.9).alias("width"))
    w = read(spark, d, "supplier").select(s.alias("wall"), c("s_nationkey").alias("storey"), ((s % 30) * num(0.1)).alias("axis"), (num(4) + s % 3).alias("length"), (s % 2 == 0).alias("paired"))
    return M.rehosted(o, w, 0.5).select("opening", "wall", micro(c("distance")).alias("distance_micro"))


@query()
def opening_dedup(spark, d):
    """Greedy acceptance per host in rank order; sequential, so rows only."""
    k = c("c_custkey")
    x0, y0 = ((k * 7) % 120) / num(10), ((k * 3) % 20) / num(10)
    return M.accepted(read(spark, d, "customer").select(c("c_nationkey").alias("host"), k.alias("opening"), (-c("c_acctbal")).alias("rank"), x0.alias("x0"), (x0 + num(1.2)).alias("x1"), y0.alias("y0"), (y0 + num(1.4)).alias("y1")))


SEG_SQL = "sg AS (SELECT s_suppkey AS wall, s_nationkey % 5 AS storey, ((s_suppkey * 7) % 100) / 10e0 AS x0, ((s_suppkey * 13) % 80) / 10e0 AS y0, ((s_suppkey * 7) % 100) / 10e0 + CASE WHEN s_suppkey % 2 = 0 THEN 2e0 ELSE 0e0 END AS x1, ((s_suppkey * 13) % 80) / 10e0 + CASE WHEN s_suppkey % 2 = 0 THEN 0e0 ELSE 2e0 END AS y1 FROM supplier)"


def segments(spark, d):
    k = c("s_suppkey")
    x0, y0 = ((k * 7) % 100) / num(10), ((k * 13) % 80) / num(10)
    return read(spark, d, "supplier").select(k.alias("wall"), (c("s_nationkey") % 5).alias("storey"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(k % 2 == 0, num(2)).otherwise(num(0))).alias("x1"), (y0 + F.when(k % 2 == 0, num(0)).otherwise(num(2))).alias("y1"))


ENDS_SQL = f"""{SEG_SQL}, en AS (SELECT wall, storey, 0 AS side, x0 AS x, y0 AS y FROM sg UNION ALL SELECT wall, storey, 1, x1, y1 FROM sg),
nr AS (SELECT e.wall, e.side, s.x0 + t * (s.x1 - s.x0) - e.x AS px, s.y0 + t * (s.y1 - s.y0) - e.y AS py, least(sqrt((s.x0 - e.x) * (s.x0 - e.x) + (s.y0 - e.y) * (s.y0 - e.y)), sqrt((s.x1 - e.x) * (s.x1 - e.x) + (s.y1 - e.y) * (s.y1 - e.y))) AS ee
 FROM en e JOIN sg s ON s.storey = e.storey AND s.wall <> e.wall, LATERAL (SELECT greatest(0e0, least(1e0, ((e.x - s.x0) * (s.x1 - s.x0) + (e.y - s.y0) * (s.y1 - s.y0)) / ((s.x1 - s.x0) * (s.x1 - s.x0) + (s.y1 - s.y0) * (s.y1 - s.y0)))) AS t)),
st AS (SELECT en.wall, en.side, CASE WHEN min(ee) <= 0.8e0 THEN 'corner' WHEN min(sqrt(px * px + py * py)) <= 0.5e0 THEN 'junction' ELSE 'free' END AS status FROM en LEFT JOIN nr ON nr.wall = en.wall AND nr.side = en.side GROUP BY en.wall, en.side)"""


def statuses(spark, d):
    s = segments(spark, d)
    sides = F.array(F.struct(lit(0).alias("side"), c("x0").alias("x"), c("y0").alias("y")), F.struct(lit(1).alias("side"), c("x1").alias("x"), c("y1").alias("y")))
    ends = s.select("wall", "storey", F.explode(sides).alias("e")).select("wall", "storey", "e.*")
    return M.endpoint_status(ends, s.withColumnRenamed("wall", "other"), 0.8, 0.5)


@query(f"WITH {ENDS_SQL} SELECT wall, side, status FROM st")
def endpoint_status(spark, d):
    return statuses(spark, d)


@query(f"WITH {ENDS_SQL} SELECT status, count(*) AS n FROM st GROUP BY status")
def endpoint_report(spark, d):
    return statuses(spark, d).groupBy("status").agg(F.count(lit(1)).alias("n"))


@query("WITH f AS (SELECT l_orderkey % 30 AS a, l_partkey % 30 AS b, l_linenumber AS band, l_quantity AS miss FROM lineitem) SELECT a, b, count(DISTINCT band) AS bands FROM f WHERE a < b AND miss <= 5 GROUP BY a, b HAVING count(DISTINCT band) >= 2")
def junction_support(spark, d):
    """Pairs of faces that meet within tolerance in at least two height bands."""
    f = read(spark, d, "lineitem").select((c("l_orderkey") % 30).alias("a"), (c("l_partkey") % 30).alias("b"), c("l_linenumber").alias("band"), c("l_quantity").alias("miss"))
    return f.where("a < b AND miss <= 5").groupBy("a", "b").agg(F.count_distinct("band").alias("bands")).where("bands >= 2")


@query("""WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN [] ELSE [p_partkey % 130 + 1, (p_partkey * 3) % 120 + 1] END AS ids FROM part), e AS (SELECT id, unnest(ids) AS source FROM o), s AS (SELECT s_suppkey AS source, s_acctbal > 0 AS confirmed FROM supplier)
SELECT o.id, coalesce(bool_and(CASE WHEN e.id IS NULL THEN NULL ELSE coalesce(confirmed, false) END), false) AS valid FROM o LEFT JOIN e USING (id) LEFT JOIN s USING (source) GROUP BY o.id""")
def slab_cut_policy(spark, d):
    """A slab opening may be cut only where it has sources, all known and confirmed."""
    k = c("p_partkey")
    ids = F.when(k % 9 == 0, F.array().cast("array<long>")).otherwise(F.array(k % 130 + 1, (k * 3) % 120 + 1))
    sources = read(spark, d, "supplier").select(c("s_suppkey").alias("source"), (c("s_acctbal") > 0).alias("confirmed"))
    return M.validated_cuts(read(spark, d, "part").select(k.alias("id"), ids.alias("source_ids")), sources)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def export_filter(spark, d):
    """Elements that are neither rejected nor hosted by a rejected one."""
    rejected = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("id")).distinct()
    e = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return M.live(e, rejected, "o_orderkey", "o_custkey").select(c("o_orderkey").alias("id"))


@query("""WITH f AS (SELECT s_nationkey AS grp, s_suppkey AS id, 500 + s_suppkey * 13 % 4000 AS length_mm, s_suppkey * 7 % 300 AS axis_mm, 100 + s_suppkey % 3 * 50 AS thickness_mm, s_suppkey % 90 AS evidence FROM supplier)
SELECT grp, CAST(sum(length_mm) AS BIGINT) AS length_mm, CAST(sum(length_mm * axis_mm) AS BIGINT) / CAST(sum(length_mm) AS BIGINT) AS axis, CAST(sum(length_mm * thickness_mm) AS BIGINT) / CAST(sum(length_mm) AS BIGINT) AS thickness, CAST(sum(evidence) AS BIGINT) AS evidence, arg_max(id, length_mm * 1000000 - id) AS reference FROM f GROUP BY grp""")
def merged_fragments(spark, d):
    """Length-weighted merge of wall fragments."""
    k = c("s_suppkey")
    f = read(spark, d, "supplier").select(c("s_nationkey").alias("grp"), k.alias("id"), (500 + k * 13 % 4000).alias("length_mm"), (k * 7 % 300).alias("axis_mm"), (100 + k % 3 * 50).alias("thickness_mm"), (k % 90).alias("evidence"))
    return M.merged_fragments(f, "grp")


MERGE_SQL = "t AS (SELECT s_suppkey AS id, s_nationkey % 5 AS kind, (s_suppkey * 7) % 100 / 10e0 AS x FROM supplier), e AS (SELECT c_custkey + 100000 AS id, c_nationkey % 5 AS kind, (c_custkey * 11) % 1000 / 100e0 AS x FROM customer), mp AS (SELECT e.id AS extra_id, min(t.id) AS target_id FROM e LEFT JOIN t ON e.kind = t.kind AND abs(e.x - t.x) <= 0.08e0 GROUP BY e.id)"


def merge_map(spark, d):
    s, k = c("s_suppkey"), c("c_custkey")
    t = read(spark, d, "supplier").select(s.alias("id"), (c("s_nationkey") % 5).alias("kind"), ((s * 7) % 100 / num(10)).alias("x"))
    e = read(spark, d, "customer").select((k + 100000).alias("id"), (c("c_nationkey") % 5).alias("kind"), ((k * 11) % 1000 / num(100)).alias("x"))
    return M.deduplicated(t, e, 0.08, 0.25)


@query(f"WITH {MERGE_SQL} SELECT extra_id, target_id FROM mp")
def merge_dedup(spark, d):
    """Elements of another model that merge into one of this."""
    return merge_map(spark, d)


@query(f"WITH {MERGE_SQL} SELECT o_orderkey, coalesce(target_id, o_custkey + 100000) AS element FROM orders LEFT JOIN mp ON mp.extra_id = o_custkey + 100000")
def id_remap(spark, d):
    """References follow the merge."""
    refs = read(spark, d, "orders").select("o_orderkey", (c("o_custkey") + 100000).alias("element"))
    return M.remapped(refs, merge_map(spark, d).where("target_id IS NOT NULL").select(c("extra_id").alias("old"), c("target_id").alias("new")), "element")


@query("""WITH st AS (SELECT n_nationkey % 20 AS id FROM nation), w AS (SELECT s_suppkey % 95 AS id, s_nationkey AS storey, 1e0 + s_suppkey % 4 AS length, (s_suppkey % 13) * 0.05e0 AS thickness FROM supplier), o AS (SELECT c_custkey AS id, c_custkey % 110 AS wall, (c_custkey % 30) * 0.1e0 AS off, 0.9e0 AS width FROM customer)
SELECT 'storey_id_repeated' AS rule, id FROM st GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'wall_id_repeated', id FROM w GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'wall_storey_missing', id FROM w WHERE storey NOT IN (SELECT id FROM st)
UNION ALL SELECT 'opening_wall_missing', id FROM o WHERE wall NOT IN (SELECT id FROM w) UNION ALL SELECT 'wall_size', id FROM w WHERE NOT (length > 0 AND thickness > 0) UNION ALL SELECT 'opening_outside', o.id FROM o JOIN w ON o.wall = w.id WHERE off < 0 OR off + width > length""")
def model_violations(spark, d):
    """Broken constraints of an element model."""
    s, k = c("s_suppkey"), c("c_custkey")
    st = read(spark, d, "nation").select((c("n_nationkey") % 20).alias("id"))
    w = read(spark, d, "supplier").select((s % 95).alias("id"), c("s_nationkey").alias("storey"), (num(1) + s % 4).alias("length"), ((s % 13) * num(0.05)).alias("thickness"))
    o = read(spark, d, "customer").select(k.alias("id"), (k % 110).alias("wall"), ((k % 30) * num(0.1)).alias("offset"), num(0.9).alias("width"))
    return M.violations(st, w, o)


@query("""WITH l AS (SELECT s_nationkey AS grp, s_suppkey AS storey, s_acctbal AS level FROM supplier), e AS (SELECT c_nationkey AS grp, c_custkey AS id, c_acctbal AS base FROM customer)
SELECT id, storey, level FROM (SELECT e.id, l.storey, l.level, row_number() OVER (PARTITION BY e.id ORDER BY l.level DESC NULLS LAST) AS k FROM e LEFT JOIN l ON e.grp = l.grp AND l.level <= e.base + 0.15e0) WHERE k = 1""")
def storey_owner(spark, d):
    """As-of join: the highest level at or a little above an element's base."""
    l = read(spark, d, "supplier").select(c("s_nationkey").alias("grp"), c("s_suppkey").alias("storey"), c("s_acctbal").alias("level"))
    e = read(spark, d, "customer").select(c("c_nationkey").alias("grp"), c("c_custkey").alias("id"), c("c_acctbal").alias("base"))
    return M.nearest_below(e, l, "base", "level", 0.15, "storey")


@query(f"""WITH {CLOUD_SQL}, r AS (SELECT sha256(CAST(round(x * 1e6) AS BIGINT) || ',' || CAST(round(y * 1e6) AS BIGINT) || ',' || CAST(round(z * 1e6) AS BIGINT)) AS h FROM cloud), p AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM r GROUP BY 1)
SELECT sha256(string_agg(p, '' ORDER BY b)) AS signature FROM p""")
def geometry_signature(spark, d):
    """Digest of quantised geometry, whatever the order of rows."""
    return M.signature(orders_cloud(spark, d), "x", "y", "z")


@query("""WITH b AS (SELECT s_nationkey AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS ordinal, s_acctbal AS v FROM supplier WHERE s_nationkey <> 4 OR s_suppkey % 2 = 0), a AS (SELECT s_nationkey AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS ordinal, s_acctbal + s_suppkey % 7 AS v FROM supplier)
SELECT kind, CASE WHEN bool_and(a.v IS NOT NULL AND b.v IS NOT NULL) THEN CAST(round(max(abs(a.v - b.v)) * 1e3) AS BIGINT) END AS change_milli FROM b FULL JOIN a USING (kind, ordinal) GROUP BY kind""")
def geometry_change(spark, d):
    """Largest change per kind between two runs."""
    from pointloom.operators.ordered import numbered

    s = read(spark, d, "supplier").select(c("s_nationkey").alias("kind"), "s_suppkey", c("s_acctbal").alias("v"))
    b = numbered(s.where("kind <> 4 OR s_suppkey % 2 = 0"), ["kind"], "s_suppkey", name="ordinal")
    a = numbered(s, ["kind"], "s_suppkey", name="ordinal").withColumn("v", c("v") + c("s_suppkey") % 7)
    return M.geometry_change(b, a, ["v"]).select("kind", F.round(c("change") * num(1e3)).cast("long").alias("change_milli"))


@query("SELECT event_type AS stage, count(*) AS records, count(DISTINCT user_id) AS unique_users, CAST(sum(event_id % 100) AS BIGINT) AS visits, max(value) AS peak, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS elapsed_us FROM events GROUP BY event_type")
def stage_rollup(spark, d):
    e = read(spark, d, "events").select(c("event_type").alias("stage"), c("user_id").alias("user"), (c("event_id") % 100).alias("visits"), c("value").alias("peak"), "ts")
    return M.stage_rollup(e)


# --- edits, fusion and alignment ---------------------------------------------------------------------


@query()
def complete_link_groups(spark, d):
    """Complete-link groups of openings per host; sequential, so rows only."""
    k = c("c_custkey")
    x0, y0 = ((k * 7) % 60) / num(10), ((k * 3) % 20) / num(10)
    return M.complete_links(read(spark, d, "customer").select(c("c_nationkey").alias("host"), k.alias("opening"), x0.alias("x0"), (x0 + num(1.2)).alias("x1"), y0.alias("y0"), (y0 + num(1.4)).alias("y1")))


@query()
def paired_openings(spark, d):
    """Openings of facing walls, each used once; greedy in order of id, so rows only."""
    o = read(spark, d, "customer").select(c("c_nationkey").alias("wall"), c("c_custkey").alias("id"), (((c("c_custkey") * 7) % 120) / num(10)).alias("x"))
    return M.nearest_free(o.where("id % 2 = 0"), o.where("id % 2 = 1"), 0.15)


@query("SELECT s_suppkey AS id, CAST(round((0e0 * (s_suppkey % 10) - 1e0 * (s_suppkey % 7) + 2.5e0) * 1e6) AS BIGINT) AS x_micro, CAST(round((1e0 * (s_suppkey % 10) + 0e0 * (s_suppkey % 7) - 1.5e0) * 1e6) AS BIGINT) AS y_micro, CAST(round((s_suppkey % 3 + 0.25e0) * 1e6) AS BIGINT) AS z_micro FROM supplier")
def transformed_model(spark, d):
    """A model turned by 90 degrees and moved."""
    k = c("s_suppkey")
    rows = read(spark, d, "supplier").select(k.alias("id"), (k % 10).cast("double").alias("x"), (k % 7).cast("double").alias("y"), (k % 3).cast("double").alias("z"))
    return M.transformed(rows, 90.0, 2.5, -1.5, 0.25, [("x", "y")], ["z"]).select("id", *[micro(c(n)).alias(f"{n}_micro") for n in "xyz"])


SPLIT_SQL = """w AS (SELECT s_suppkey AS id, 6e0 AS length FROM supplier), cu AS (SELECT DISTINCT c_custkey % 100 + 1 AS id, (c_custkey % 12) * 0.5e0 AS at_ FROM customer), o AS (SELECT p_partkey AS opening, p_partkey % 100 + 1 AS id, (p_partkey % 17) * 0.3e0 AS offs, 0.6e0 AS width FROM part WHERE p_partkey % 9 = 0),
f AS (SELECT cu.id, at_ FROM cu JOIN w USING (id) WHERE at_ >= 0.5e0 AND length - at_ >= 0.5e0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.id = cu.id AND offs < at_ AND offs + width > at_)), m AS (SELECT id, 0e0 AS at_ FROM w UNION ALL SELECT * FROM f),
p AS (SELECT m.id, CAST(row_number() OVER (PARTITION BY m.id ORDER BY at_) AS INTEGER) AS part, at_ AS lo, coalesce(lead(at_) OVER (PARTITION BY m.id ORDER BY at_), length) AS hi FROM m JOIN w USING (id))"""


def split(spark, d):
    s, k, p = c("s_suppkey"), c("c_custkey"), c("p_partkey")
    walls = read(spark, d, "supplier").select(s.alias("id"), num(6).alias("length"))
    cuts = read(spark, d, "customer").select((k % 100 + 1).alias("id"), ((k % 12) * num(0.5)).alias("at")).distinct()
    openings = read(spark, d, "part").where(p % 9 == 0).select(p.alias("opening"), (p % 100 + 1).alias("id"), ((p % 17) * num(0.3)).alias("offset"), num(0.6).alias("width"))
    return M.split_walls(walls, cuts, openings, 0.5)


@query(f"WITH {SPLIT_SQL} SELECT id, part, lo, hi FROM p")
def split_walls(spark, d):
    """Walls cut where no opening is cut through and no part is too short."""
    return split(spark, d)[0]


@query(f"WITH {SPLIT_SQL} SELECT opening, o.id, part, CAST(round((offs - lo) * 1e6) AS BIGINT) AS offset_micro FROM o JOIN p USING (id) WHERE offs >= lo AND offs + width <= hi")
def reassigned_openings(spark, d):
    """Openings follow their part of a split wall."""
    return split(spark, d)[1].select("opening", "id", "part", micro(c("offset")).alias("offset_micro"))
