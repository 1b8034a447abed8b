"""Split, fold and sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import split as S
from tessera.plans.base import query, rounded, sql_hash, table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


def _rank(seed: int, part: str = "") -> str:
    return f"row_number() OVER ({part} ORDER BY {sql_hash(seed, 'o_orderkey')}, o_orderkey)"


_BY = "PARTITION BY o_orderstatus"


@query("spl1_random_split", f"""WITH r AS (SELECT o_orderkey, {_rank(42)} AS r, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    return S.random_split(_orders(spark, d).select("o_orderkey"), 0.2, 42, "o_orderkey")


@query("spl2_stratified_split", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {_rank(42, _BY)} AS r, count(*) OVER ({_BY}) AS n FROM orders)
 SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    return S.stratified_split(_orders(spark, d), "o_orderstatus", 0.2, 42, "o_orderkey")


@query("spl3_three_way_split", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {_rank(42, _BY)} AS r, count(*) OVER ({_BY}) AS n FROM orders),
 dev AS (SELECT o_orderkey, o_orderstatus, {_rank(59, _BY)} AS r, count(*) OVER ({_BY}) AS n FROM r WHERE r > floor(n * 0.2::DOUBLE + 0.5))
 SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.25::DOUBLE + 0.5) THEN 'val' ELSE 'fit' END AS split FROM dev
 UNION ALL SELECT o_orderkey, o_orderstatus, 'test' FROM r WHERE r <= floor(n * 0.2::DOUBLE + 0.5)""")
def _(spark, d):
    return S.three_way_split(_orders(spark, d), "o_orderstatus", 42, "o_orderkey")


@query("spl4_stratified_take", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {_rank(7, _BY)} AS r, count(*) OVER ({_BY}) AS n, count(*) OVER () AS t FROM orders)
 SELECT o_orderkey, o_orderstatus FROM r WHERE r <= greatest(1, floor(n * (600 / t::DOUBLE)))""")
def _(spark, d):
    return S.stratified_take(_orders(spark, d), "o_orderstatus", 600, 7, "o_orderkey")


@query("spl5_selection_subsets", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {_rank(42, _BY)} AS r, count(*) OVER ({_BY}) AS n FROM orders),
 dev AS (SELECT o_orderkey, o_orderstatus, {_rank(59, _BY)} AS r, count(*) OVER ({_BY}) AS n FROM r WHERE r > floor(n * 0.2::DOUBLE + 0.5)),
 s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.25::DOUBLE + 0.5) THEN 'val' ELSE 'fit' END AS split FROM dev UNION ALL SELECT o_orderkey, o_orderstatus, 'test' FROM r WHERE r <= floor(n * 0.2::DOUBLE + 0.5)),
 q AS (SELECT *, row_number() OVER (PARTITION BY split, o_orderstatus ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY split, o_orderstatus) AS n, count(*) OVER (PARTITION BY split) AS t FROM s)
 SELECT o_orderkey, o_orderstatus, split FROM q WHERE t <= CASE split WHEN 'fit' THEN 3000 ELSE 1500 END OR r <= greatest(1, floor(n * (CASE split WHEN 'fit' THEN 3000 ELSE 1500 END / t::DOUBLE)))""")
def _(spark, d):
    parts = S.three_way_split(_orders(spark, d), "o_orderstatus", 42, "o_orderkey")
    most = {"fit": 3000, "val": 1500, "test": 1500}
    out = None
    for name, n in most.items():
        part = S.stratified_take(parts.where(F.col("split") == name), "o_orderstatus", n, 42, "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


@query("spl6_k_fold", f"SELECT o_orderkey, (({_rank(42)} - 1) % 5)::BIGINT AS fold FROM orders")
def _(spark, d):
    return rounded(S.k_fold(_orders(spark, d).select("o_orderkey"), 5, 42, "o_orderkey"))


@query("spl7_stratified_k_fold", f"SELECT o_orderkey, o_orderstatus, (({_rank(42, _BY)} - 1) % 5)::BIGINT AS fold FROM orders")
def _(spark, d):
    return rounded(S.k_fold(_orders(spark, d), 5, 42, "o_orderkey", "o_orderstatus"))


@query("spl8_repeated_k_fold", " UNION ALL ".join(f"SELECT o_orderkey, o_orderstatus, (({_rank(42 + r, _BY)} - 1) % 4)::BIGINT AS fold, {r}::BIGINT AS repeat FROM orders" for r in range(3)))
def _(spark, d):
    return rounded(S.repeated_k_fold(_orders(spark, d), 4, 3, 42, "o_orderkey", "o_orderstatus"))


@query("spl10_sample_rows", f"WITH r AS (SELECT o_orderkey, {_rank(11)} AS r FROM orders) SELECT o_orderkey FROM r WHERE r <= 500")
def _(spark, d):
    return S.sample_rows(_orders(spark, d).select("o_orderkey"), 500, 11, "o_orderkey")


@query("prj3_balanced_subsample", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {_rank(3, _BY)} AS r FROM orders), n AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
 SELECT o_orderkey, o_orderstatus FROM r, n WHERE r <= least""")
def _(spark, d):
    return S.balanced_subsample(_orders(spark, d), "o_orderstatus", 3, "o_orderkey")


@query("prj4_fraction", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {sql_hash(5, 'o_orderkey')} < {int(0.3 * (1 << 32))}")
def _(spark, d):
    return S.fraction(_orders(spark, d), 0.3, 5, "o_orderkey")


@query("mod7_class_weight", """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o.o_orderkey, o.o_orderstatus, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM orders o JOIN c USING (o_orderstatus)""")
def _(spark, d):
    return rounded(S.class_weight(_orders(spark, d), "o_orderstatus"))
