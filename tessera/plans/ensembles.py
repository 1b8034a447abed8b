"""Voting, stacking, distillation and clustering queries over prediction and label tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import ensemble as E
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators.ranking import linear_quantiles
from tessera.plans.base import MULTI_SQL, PRED_SQL, REG_SQL, multiclass, predictions, query, regression, rounded, table

_LONGP = f"WITH {PRED_SQL}, long AS (SELECT row_id, 'a' AS model, p FROM pred UNION ALL SELECT row_id, 'b', q FROM pred UNION ALL SELECT row_id, 'c', 1 - p * q FROM pred)"


def _models(spark, d):
    return predictions(spark, d).select("row_id", "y", F.col("p").alias("a"), F.col("q").alias("b"), (1 - F.col("p") * F.col("q")).alias("c"))


@query("stk8_soft_vote", f"{_LONGP} SELECT row_id, round(avg(p), 9) AS vote FROM long GROUP BY row_id")
def _(spark, d):
    vote = E.soft_vote(_models(spark, d).unpivot(["row_id"], ["a", "b", "c"], "model", "p"))
    return vote.select("row_id", F.round("vote", 9).alias("vote"))


@query("stk2_weight_handling", f"WITH {PRED_SQL} SELECT row_id, round(p * 0.5 + q * 0.3 + (1 - p * q) * 0.2, 6) AS weighted_mean, round(p * 1.5, 6) AS scaled, round(p * 0.5, 6) AS multiplied FROM pred")
def _(spark, d):
    w = {"a": 5.0, "b": 3.0, "c": 2.0}
    m = _models(spark, d)
    out = E.weighted_features(m, w, "as_feature").select("row_id", "weighted_mean")
    scaled = E.weighted_features(m, w, "scale_features").select("row_id", F.col("a").alias("scaled"))
    times = E.weighted_features(m, w, "multiply_proba").select("row_id", F.col("a").alias("multiplied"))
    return rounded(out.join(scaled, "row_id").join(times, "row_id"))


@query("stk7_inverse_rmse", f"WITH {REG_SQL}, w AS (SELECT 1 / avg((p - y) * (p - y)) AS a, 1 / avg((q - y) * (q - y)) AS b FROM reg) SELECT row_id, round((p * a + q * b) / (a + b), 4) AS blend FROM reg, w")
def _(spark, d):
    reg = regression(spark, d)
    return reg.select("row_id", F.round(E.weighted(E.inverse_rmse_weights(reg, "y", ["p", "q"])), 4).alias("blend"))


@query("stk10_ensemble_plans", f"WITH {REG_SQL}, w AS (SELECT 1 / avg((p - y) * (p - y)) AS a, 1 / avg((q - y) * (q - y)) AS b FROM reg), p AS (SELECT 'best_single' AS plan, p - y AS e FROM reg UNION ALL SELECT 'mean', (p + q) / 2 - y FROM reg UNION ALL SELECT 'weighted', (p * a + q * b) / (a + b) - y FROM reg, w) SELECT plan, round(sqrt(avg(e * e)), 6) AS rmse FROM p GROUP BY plan")
def _(spark, d):
    reg = regression(spark, d)
    plans = {"best_single": F.col("p"), "mean": (F.col("p") + F.col("q")) / 2, "weighted": E.weighted(E.inverse_rmse_weights(reg, "y", ["p", "q"]))}
    one = reg.agg(*[F.sqrt(F.avg(F.pow(c - F.col("y"), 2))).alias(n) for n, c in plans.items()])
    return rounded(one.unpivot([], list(plans), "plan", "rmse"))


@query("stk11_prefix_means", f"WITH {PRED_SQL}, l AS (SELECT y, p AS m1, (p + q) / 2 AS m2, (p + q + 1 - p * q) / 3 AS m3 FROM pred), k AS (SELECT y, unnest([1, 2, 3]) AS k, unnest([m1, m2, m3]) AS m FROM l) SELECT k::BIGINT AS k, round(avg((m - y) * (m - y)), 6) AS brier FROM k GROUP BY k")
def _(spark, d):
    rank = F.create_map(*map(F.lit, ("a", 1, "b", 2, "c", 3)))
    long = _models(spark, d).unpivot(["row_id", "y"], ["a", "b", "c"], "model", "p").withColumn("rank", rank[F.col("model")])
    return rounded(E.prefix_means(long, "rank", ["row_id"]).groupBy("k").agg(F.avg(F.pow(F.col("mean") - F.col("y"), 2)).alias("brier")))


@query("dis3_soft_targets", f"WITH {MULTI_SQL}, e AS (SELECT y, exp(pf / 3) AS f, exp(po / 3) AS o, exp(pp / 3) AS p FROM multi), r AS (SELECT y, unnest(['F', 'O', 'P']) AS class, unnest([f, o, p]) AS e, f + o + p AS t FROM e) SELECT y, class, round(sum(0.5 * (y = class)::INT + 0.5 * e / t), 4) AS weight FROM r GROUP BY ALL")
def _(spark, d):
    targets = E.soft_targets(multiclass(spark, d), "y", F.array("pf", "po", "pp"), ["F", "O", "P"])
    return targets.groupBy("y", "class").agg(F.round(F.sum("weight"), 4).alias("weight"))


@query("dis4_kd_loss", f"WITH {MULTI_SQL}, e AS (SELECT exp(pf / 3) AS f, exp(po / 3) AS o, exp(pp / 3) AS p, exp(pf / 6) AS g, exp(po / 6) AS h, exp(pp / 6) AS i FROM multi) SELECT round(avg(9 * (f / (f + o + p) * ln(f / (f + o + p) / (g / (g + h + i))) + o / (f + o + p) * ln(o / (f + o + p) / (h / (g + h + i))) + p / (f + o + p) * ln(p / (f + o + p) / (i / (g + h + i))))), 6) AS loss FROM e")
def _(spark, d):
    from tessera.functions.scalar import binary_kd

    loss = binary_kd(F.array("pf", "po", "pp"), F.array(*[F.col(c) / 2 for c in ("pf", "po", "pp")]))
    return rounded(multiclass(spark, d).agg(F.avg(loss).alias("loss")))


@query("dis7_delivery_ratios", "SELECT l_returnflag AS task, round(median(l_extendedprice), 6) AS teacher, round(median(l_quantity), 6) AS student, round(median(l_extendedprice) / median(l_quantity), 6) AS factor FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(E.delivery_ratios(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "task"), "l_extendedprice", "l_quantity", ["task"]))


@query("fid4_retention", f"WITH {PRED_SQL}, b AS (SELECT dataset, seed, avg((p - y) * (p - y)) AS t, avg((q - y) * (q - y)) AS s FROM pred GROUP BY ALL) SELECT dataset, seed, round(t / s, 6) AS retention, round(s - t, 6) AS delta, s <= 1.1 * t AS within FROM b")
def _(spark, d):
    gap = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    b = predictions(spark, d).groupBy("dataset", "seed").agg(gap("p").alias("t"), gap("q").alias("s"))
    return rounded(b.select("dataset", "seed", F.try_divide("t", "s").alias("retention"), (F.col("s") - F.col("t")).alias("delta"), (F.col("s") <= 1.1 * F.col("t")).alias("within")))


@query("fid7_display_scores", f"WITH {PRED_SQL}, b AS (SELECT dataset, seed, avg(p) - avg(q) AS v, avg(p) / avg(q) AS r FROM pred GROUP BY ALL) SELECT dataset, seed, round(least(greatest((v + 0.05) / 0.05, 0), 1), 6) AS control, round(least(greatest(r, 0), 1), 6) AS retention, round(1 / r, 6) AS speed_x FROM b")
def _(spark, d):
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    b = predictions(spark, d).groupBy("dataset", "seed").agg((F.avg("p") - F.avg("q")).alias("v"), F.try_divide(F.avg("p"), F.avg("q")).alias("r"))
    return rounded(b.select("dataset", "seed", unit((F.col("v") + 0.05) / 0.05).alias("control"), unit(F.col("r")).alias("retention"), F.try_divide(F.lit(1.0), F.col("r")).alias("speed_x")))


_PTS = "pts AS (SELECT c_custkey AS row_id, c_nationkey % 4 AS label, c_acctbal / 1000 AS x, c_custkey % 100 / 10.0::DOUBLE AS z FROM customer)"


def _points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") % 4).alias("label"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 100 / 10.0).alias("z"))


@query("evk6_internal_scores", f"""WITH {_PTS}, c AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(z) AS cz FROM pts GROUP BY label), s AS (SELECT p.label, avg(sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz))) AS s, sum((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS w FROM pts p JOIN c USING (label) GROUP BY p.label),
 k AS (SELECT * FROM c JOIN s USING (label)), r AS (SELECT a.label, max((a.s + b.s) / sqrt((a.cx - b.cx) ** 2 + (a.cz - b.cz) ** 2)) AS r FROM k a JOIN k b ON a.label <> b.label GROUP BY a.label), m AS (SELECT avg(x) AS mx, avg(z) AS mz, count(*) AS n FROM pts)
 SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round((SELECT sum(k.n * ((cx - mx) ** 2 + (cz - mz) ** 2)) * (any_value(m.n) - count(*)) / (sum(w) * (count(*) - 1)) FROM k, m), 6) AS calinski_harabasz""")
def _(spark, d):
    return rounded(K.internal_scores(_points(spark, d), "label", ["x", "z"]))


@query("cal9_cluster_confidence", f"WITH {_PTS}, c AS (SELECT label, avg(x) AS cx, avg(z) AS cz FROM pts GROUP BY label), e AS (SELECT row_id, label, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS d FROM pts JOIN c USING (label)) SELECT row_id, label::BIGINT AS label, round(1 - d / max(d) OVER (), 6) AS confidence FROM e")
def _(spark, d):
    return rounded(K.confidence(_points(spark, d), "label", ["x", "z"], "row_id"))


_LAB = "labs AS (SELECT c_custkey AS row_id, 'a' AS candidate, c_nationkey % 4 AS label FROM customer UNION ALL SELECT c_custkey, 'b', (c_nationkey + 1) % 4 FROM customer UNION ALL SELECT c_custkey, 'c', CASE WHEN c_acctbal > 5000 THEN c_nationkey % 4 ELSE c_custkey % 4 END FROM customer UNION ALL SELECT c_custkey, 'flat', 0 FROM customer)"


def _labelings(spark, d):
    c = table(spark, d, "customer")
    kinds = {"a": F.col("c_nationkey") % 4, "b": (F.col("c_nationkey") + 1) % 4, "c": F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey") % 4).otherwise(F.col("c_custkey") % 4), "flat": F.lit(0)}
    return c.select(F.col("c_custkey").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), e.cast("long").alias("label")) for n, e in kinds.items()])).alias("x")).select("row_id", "x.*")


@query("flt8_valid_labelings", f"WITH {_LAB} SELECT candidate, count(*) AS n, count(DISTINCT label) AS k FROM labs GROUP BY candidate HAVING count(DISTINCT label) > 1 AND count(DISTINCT label) < count(*)")
def _(spark, d):
    return K.valid_labelings(_labelings(spark, d))


@query("cns1_majority_vote", f"WITH {_LAB}, v AS (SELECT row_id, label, count(*) AS v FROM labs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, label) AS r FROM v) SELECT row_id, label::BIGINT AS label FROM r WHERE r = 1")
def _(spark, d):
    return K.majority_vote(_labelings(spark, d))


@query("cns2_weighted_vote", f"WITH {_LAB}, v AS (SELECT row_id, label, sum(CASE candidate WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 WHEN 'c' THEN 0.25 ELSE 0.1 END) AS v FROM labs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, label) AS r FROM v) SELECT row_id, label::BIGINT AS label FROM r WHERE r = 1")
def _(spark, d):
    weights = F.create_map(*[x for k, v in (("a", 0.5), ("b", 0.3), ("c", 0.25), ("flat", 0.1)) for x in (F.lit(k), F.lit(v).cast("decimal(4,2)"))])
    return K.majority_vote(_labelings(spark, d).withColumn("w", weights[F.col("candidate")]), "w")


def _cells(spark, d):
    long = _labelings(spark, d)
    anchor = long.where("candidate = 'a'").select("row_id", F.col("label").alias("ref"))
    return long.where("candidate <> 'a'").join(anchor, "row_id").groupBy("candidate", "label", "ref").agg(F.count("*").alias("n"))


@query("cns4_overlap_alignment", f"WITH {_LAB}, n AS (SELECT l.candidate, l.label, a.label AS ref, count(*) AS n FROM labs l JOIN labs a USING (row_id) WHERE a.candidate = 'a' AND l.candidate = 'c' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, ref) AS r FROM n) SELECT label::BIGINT AS label, ref::BIGINT AS ref FROM r WHERE r = 1")
def _(spark, d):
    return K.align_by_overlap(_cells(spark, d).where("candidate = 'c'"), "label", "ref")


#: The one-to-one mappings of four labels, and each labeling's of the greatest overlap.
PERMUTATIONS_SQL = "r AS (SELECT unnest(range(4)) AS x), p AS (SELECT [a.x, b.x, c.x, e.x] AS m FROM r a, r b, r c, r e WHERE a.x <> b.x AND a.x <> c.x AND a.x <> e.x AND b.x <> c.x AND b.x <> e.x AND c.x <> e.x)"
_ALIGNED = f"n AS (SELECT l.candidate, l.label, a.label AS ref, count(*) AS n FROM labs l JOIN labs a USING (row_id) WHERE a.candidate = 'a' AND l.candidate <> 'a' GROUP BY ALL), {PERMUTATIONS_SQL}, t AS (SELECT candidate, m, sum(n) AS t FROM n, p WHERE ref = m[label + 1] GROUP BY ALL), b AS (SELECT candidate, m FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY t DESC, m) AS i FROM t) WHERE i = 1), al AS (SELECT DISTINCT candidate, label, m[label + 1] AS aligned FROM n JOIN b USING (candidate))"


@query("cns3_optimal_alignment", f"WITH {_LAB}, {_ALIGNED} SELECT candidate, label::BIGINT AS label, aligned::BIGINT AS aligned FROM al")
def _(spark, d):
    return K.align_optimal(_cells(spark, d), "candidate", "label", "ref")


@query("cns5_aligned_vote", f"WITH {_LAB}, {_ALIGNED}, v AS (SELECT row_id, coalesce(aligned, label) AS label, count(*) AS v FROM labs LEFT JOIN al USING (candidate, label) WHERE candidate <> 'flat' GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, label) AS i FROM v) SELECT row_id, label::BIGINT AS label FROM w WHERE i = 1")
def _(spark, d):
    """Labelings aligned to the anchor one to one, then a majority vote."""
    long = _labelings(spark, d).where("candidate <> 'flat'")
    mapped = long.join(K.align_optimal(_cells(spark, d), "candidate", "label", "ref"), ["candidate", "label"], "left")
    return K.majority_vote(mapped.select("row_id", "candidate", F.coalesce("aligned", "label").alias("label")))


@query("cns6_signature_graph", f"WITH {_LAB}, r AS (SELECT row_id, max(label) FILTER (candidate = 'a') AS a, max(label) FILTER (candidate = 'b') AS b, max(label) FILTER (candidate = 'c') AS c FROM labs GROUP BY row_id), s AS (SELECT a, b, c, count(*) AS n, min(row_id) AS f FROM r GROUP BY ALL) SELECT x.f AS a, y.f AS b, x.n AS na, y.n AS nb, round(((x.a = y.a)::INT + (x.b = y.b)::INT + (x.c = y.c)::INT) / 3.0::DOUBLE, 6) AS similarity FROM s x JOIN s y ON x.f < y.f AND (x.a = y.a OR x.b = y.b OR x.c = y.c)")
def _(spark, d):
    return rounded(K.signature_graph(_labelings(spark, d).where("candidate <> 'flat'")))


@query("evk4_pairwise_ari", f"WITH {_LAB}, n AS (SELECT a.candidate AS ca, b.candidate AS cb, a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM labs a JOIN labs b USING (row_id) WHERE a.candidate < b.candidate AND a.candidate <> 'flat' AND b.candidate <> 'flat' GROUP BY ALL), x AS (SELECT ca, cb, sum(x * (x - 1) / 2) AS sa FROM (SELECT ca, cb, la, sum(n) AS x FROM n GROUP BY ALL) GROUP BY ca, cb), y AS (SELECT ca, cb, sum(x * (x - 1) / 2) AS sb FROM (SELECT ca, cb, lb, sum(n) AS x FROM n GROUP BY ALL) GROUP BY ca, cb), s AS (SELECT ca, cb, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM n GROUP BY ca, cb) SELECT round(avg((s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)), 6) AS mean_ari, count(*) AS pairs FROM x JOIN y USING (ca, cb) JOIN s USING (ca, cb)")
def _(spark, d):
    """Mean ARI over all pairs of labelings, each pair from its contingency counts."""
    long = _labelings(spark, d).where("candidate <> 'flat'")
    a, b = long.withColumnsRenamed({"candidate": "ca", "label": "la"}), long.withColumnsRenamed({"candidate": "cb", "label": "lb"})
    cells = a.join(b, "row_id").where("ca < cb").groupBy("ca", "cb", "la", "lb").agg(F.count("*").alias("n"))
    return rounded(M.label_scores(cells, "la", "lb", by=["ca", "cb"]).agg(F.avg("ari").alias("mean_ari"), F.count("*").alias("pairs")))


@query("fid6_assignment_fidelity", f"WITH {_LAB}, j AS (SELECT row_id % 2 AS split, a.label AS t, c.label AS s FROM labs a JOIN labs c USING (row_id) WHERE a.candidate = 'a' AND c.candidate = 'c') SELECT split::BIGINT AS split, round(avg((t = s)::INT), 6) AS match, count(*) AS n FROM j GROUP BY split")
def _(spark, d):
    long = _labelings(spark, d)
    j = long.where("candidate = 'a'").select("row_id", F.col("label").alias("t")).join(long.where("candidate = 'c'").select("row_id", F.col("label").alias("s")), "row_id")
    return rounded(j.groupBy((F.col("row_id") % 2).alias("split")).agg(F.avg((F.col("t") == F.col("s")).cast("double")).alias("match"), F.count("*").alias("n")))


@query("jn9_nearest_neighbours", f"WITH {_PTS}, q AS (SELECT * FROM pts WHERE row_id % 20 = 0), d AS (SELECT q.row_id AS query, p.row_id AS neighbour, sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) AS d FROM q JOIN pts p ON p.row_id <> q.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS r FROM d) SELECT query, round(avg(d), 6) AS mean_distance, count(*) AS k FROM r WHERE r <= 10 GROUP BY query")
def _(spark, d):
    pts = _points(spark, d)
    return rounded(K.knn_join(pts, "row_id", ["x", "z"], 10, pts.where("row_id % 20 = 0")).groupBy("query").agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("k")))


@query("dis6_label_transfer", f"WITH {_PTS}, q AS (SELECT * FROM pts WHERE row_id % 20 = 0), d AS (SELECT q.row_id AS query, p.label, (p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z) AS d, p.row_id AS n FROM q JOIN pts p ON p.row_id <> q.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sqrt(d), n) AS r FROM d) SELECT query, label::BIGINT AS label FROM r WHERE r = 1")
def _(spark, d):
    pts = _points(spark, d)
    near = K.knn_join(pts, "row_id", ["x", "z"], 1, pts.where("row_id % 20 = 0"))
    return rounded(near.join(pts.select(F.col("row_id").alias("neighbour"), "label"), "neighbour").select("query", "label"))


@query("evk8_neighbour_agreement", f"WITH {_PTS}, l AS (SELECT *, row_id % 3 AS other FROM pts), q AS (SELECT * FROM l WHERE row_id % 20 = 0), d AS (SELECT q.row_id AS query, (p.label = q.label) = (p.other = q.other) AS same, sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) AS d, p.row_id AS n FROM q JOIN l p ON p.row_id <> q.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, n) AS r FROM d) SELECT round(avg(same::INT), 6) AS agreement FROM r WHERE r <= 10")
def _(spark, d):
    pts = _points(spark, d).withColumn("other", F.col("row_id") % 3)
    near = K.knn_join(pts, "row_id", ["x", "z"], 10, pts.where("row_id % 20 = 0"))
    side = lambda n: pts.select(F.col("row_id").alias(n), F.col("label").alias(f"l_{n}"), F.col("other").alias(f"o_{n}"))
    both = near.join(side("query"), "query").join(side("neighbour"), "neighbour")
    same = (F.col("l_query") == F.col("l_neighbour")) == (F.col("o_query") == F.col("o_neighbour"))
    return rounded(both.agg(F.avg(same.cast("double")).alias("agreement")))


@query("evk5_euclidean_silhouette", f"WITH {_PTS}, q AS (SELECT * FROM pts WHERE row_id % 20 = 0), n AS (SELECT label, count(*) AS n FROM pts GROUP BY label), t AS (SELECT q.row_id AS query, q.label AS own, p.label, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z))) AS t FROM q, pts p GROUP BY ALL), m AS (SELECT query, own, max(CASE WHEN t.label = own THEN t / (n - 1) END) AS a, min(CASE WHEN t.label <> own THEN t / n END) AS b FROM t JOIN n USING (label) GROUP BY query, own) SELECT query, own::BIGINT AS label, round((b - a) / greatest(a, b), 6) AS silhouette FROM m")
def _(spark, d):
    """Euclidean silhouette of every twentieth customer against all of them."""
    from tessera.operators.neighbours import silhouettes

    pts = _points(spark, d)
    return rounded(silhouettes(pts, "row_id", "label", ["x", "z"], pts.where("row_id % 20 = 0")))


@query("clu4_projection_bins", "WITH p AS (SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x / i)) AS s FROM embeddings), q AS (SELECT quantile_cont(s, 0.25) AS a, median(s) AS b, quantile_cont(s, 0.75) AS c FROM p) SELECT vec_id, ((s > a)::INT + (s > b)::INT + (s > c)::INT)::BIGINT AS label FROM p, q")
def _(spark, d):
    """Quartiles along a fixed direction over the whole embedding."""
    s = F.expr("aggregate(transform(embedding, (x, i) -> cast(x as double) / (i + 1)), 0D, (a, x) -> a + x)")
    p = table(spark, d, "embeddings").select("vec_id", s.alias("s"))
    edges = linear_quantiles(p, "s", {"a": 0.25, "b": 0.5, "c": 0.75})  # one row
    above = sum(((F.col("s") > F.col(e)).cast("int") for e in "bc"), (F.col("s") > F.col("a")).cast("int"))
    return rounded(p.crossJoin(F.broadcast(edges)).select("vec_id", above.alias("label")))


@query("clu4_principal_bins")
def _(spark, d):
    """Quartiles of the first principal direction of the whole standardised embedding; SQL covers the fixed direction of clu4_projection_bins."""
    features = L.from_array(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return K.projection_bins(features, "vec_id", 4).select("vec_id", "label")
