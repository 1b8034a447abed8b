"""Feature program and screening queries; one a vocabulary group of the program language."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import features as P
from tessera.operators.features import Feature
from tessera.operators.ranking import linear_quantiles, range_rank
from tessera.plans.base import query, rounded, table


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_shipdate", "l_orderkey", "l_partkey")


def _totals(df, names, by="l_linenumber", digits=3):
    return rounded(df.groupBy(by).agg(*[F.round(F.sum(F.col(n).cast("double")), digits).alias(n) for n in names]))


def _sql(columns: dict[str, str], by: str = "l_linenumber", digits: int = 3) -> str:
    return f"SELECT {by}{'::BIGINT' if by == 'l_linenumber' else ''} AS {by}, " + ", ".join(f"round(sum(({e})::DOUBLE), {digits}) AS {n}" for n, e in columns.items()) + f" FROM lineitem GROUP BY {by}"


def _program(name: str, features: dict[str, tuple[str, str]]):
    """A query that sums each feature by line number: Spark expression and the same in the oracle's SQL."""

    @query(name, _sql({n: q for n, (_, q) in features.items()}))
    def run(spark, d):
        df = P.apply_program([Feature(n, e) for n, (e, _) in features.items()], _li(spark, d))
        return _totals(df, list(features))


_program("fea1_arithmetic", {
    "net": ("l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 - l_discount)"), "unit": ("try_divide(l_extendedprice, l_quantity)", "l_extendedprice / nullif(l_quantity, 0)"),
    "whole": ("floor(l_quantity / 7)", "floor(l_quantity / 7)"), "rest": ("pmod(l_orderkey, 7)", "l_orderkey % 7"), "power": ("pow(l_quantity, 2)", "power(l_quantity, 2)"),
})
_program("fea2_comparisons", {
    "big": ("cast(l_quantity >= 25 as int)", "(l_quantity >= 25)::INT"), "listed": ("cast(l_returnflag in ('R', 'N') as int)", "(l_returnflag IN ('R', 'N'))::INT"),
    "middle": ("cast(l_quantity between 10 and 20 and not l_tax > 0.04 as int)", "(l_quantity BETWEEN 10 AND 20 AND NOT l_tax > 0.04)::INT"),
})
_program("fea3_math", {
    "root": ("sqrt(l_quantity)", "sqrt(l_quantity)"), "ln": ("ln(l_extendedprice)", "ln(l_extendedprice)"), "lg": ("log10(l_extendedprice)", "log10(l_extendedprice)"), "l1": ("log1p(l_quantity)", "ln(1 + l_quantity)"),
    "ex": ("exp(l_discount)", "exp(l_discount)"), "m1": ("expm1(l_tax)", "exp(l_tax) - 1"), "clip": ("least(greatest(l_quantity, 10), 40)", "least(greatest(l_quantity, 10), 40)"),
})
_program("fea4_conditional", {
    "chosen": ("if(l_quantity > 30, l_extendedprice, -1)", "CASE WHEN l_quantity > 30 THEN l_extendedprice ELSE -1 END"),
    "mapped": ("element_at(map('A', 1, 'N', 2, 'R', 3), l_returnflag)", "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"),
})
_program("fea5_nulls", {
    "holes": ("if(l_orderkey % 5 = 0, null, l_quantity)", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END"), "missing": ("cast(holes is null as int)", "(l_orderkey % 5 = 0)::INT"),
    "filled": ("coalesce(holes, 25D)", "CASE WHEN l_orderkey % 5 = 0 THEN 25 ELSE l_quantity END"),
})
_program("fea18_vectors", {
    "dot": ("aggregate(zip_with(array(l_quantity, l_tax), array(l_discount, 2D), (a, b) -> a * b), 0D, (s, x) -> s + x)", "l_quantity * l_discount + l_tax * 2"),
    "spread": ("greatest(l_quantity, l_tax, l_discount) - least(l_quantity, l_tax, l_discount)", "greatest(l_quantity, l_tax, l_discount) - least(l_quantity, l_tax, l_discount)"),
    "any": ("cast(exists(array(l_tax, l_discount), x -> x = 0) as int)", "(l_tax = 0 OR l_discount = 0)::INT"),
})
_program("fea19_interaction", {"discount_tax": ("l_discount * l_tax", "l_discount * l_tax")})


@query("fea6_cut_qcut", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, median(o_totalprice) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT least(floor(o_totalprice / 100000), 4)::BIGINT AS cut, ((o_totalprice > a)::INT + (o_totalprice > b)::INT + (o_totalprice > c)::INT)::BIGINT AS qcut, count(*) AS n FROM orders, q GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders").select("o_totalprice")
    edges = linear_quantiles(o, "o_totalprice", {"a": 0.25, "b": 0.5, "c": 0.75})  # one row
    above = sum(((F.col("o_totalprice") > F.col(e)).cast("int") for e in "bc"), (F.col("o_totalprice") > F.col("a")).cast("int"))
    both = o.crossJoin(F.broadcast(edges)).select(F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).alias("cut"), above.alias("qcut"))
    return rounded(both.groupBy("cut", "qcut").agg(F.count("*").alias("n")))


@query("fea7_group_statistics", """WITH g AS (SELECT l_suppkey, avg(l_quantity) AS m, median(l_quantity) AS md, count(DISTINCT l_returnflag) AS k, stddev_samp(l_quantity) AS s FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_suppkey)
 SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(m), 3) AS supp_mean, round(sum(md), 3) AS supp_median, round(sum(k), 3) AS supp_flags, round(sum(s), 3) AS supp_std FROM lineitem JOIN g USING (l_suppkey) GROUP BY 1""")
def _(spark, d):
    li = _li(spark, d)
    fit = li.where("l_linenumber <= 5")
    sums = fit.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("supp_mean"), F.stddev_samp("l_quantity").alias("supp_std"))
    flags = fit.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("_n")).groupBy("l_suppkey").agg(F.count("l_returnflag").alias("supp_flags"))
    fitted = sums.join(flags, "l_suppkey").join(linear_quantiles(fit, "l_quantity", {"supp_median": 0.5}, ["l_suppkey"]), "l_suppkey")
    return _totals(li.join(fitted, "l_suppkey"), ["supp_mean", "supp_median", "supp_flags", "supp_std"])


_EV = "WITH e AS (SELECT event_id, user_id, ts, value, event_type FROM events)"


def _ev(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")


@query("fea8_running", f"{_EV} SELECT event_id, round(sum(value) OVER w, 4) AS cumsum, round(max(value) OVER w, 6) AS cummax, round(min(value) OVER w, 6) AS cummin FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _ev(spark, d).select("event_id", F.round(F.sum("value").over(w), 4).alias("cumsum"), F.round(F.max("value").over(w), 6).alias("cummax"), F.round(F.min("value").over(w), 6).alias("cummin"))


@query("fea8_cumulative_product", "SELECT c_nationkey::BIGINT AS g, c_custkey AS k, round(product(1 + c_acctbal / 100000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 6) AS p FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), (1 + F.col("c_acctbal") / 100000).alias("x"))
    return rounded(P.running_product(c, "x", ["g"], "k", "p").select("g", "k", "p"))


@query("fea9_lagged", f"{_EV} SELECT event_id, round(lag(value, 2) OVER w, 6) AS shift, round(value - lag(value) OVER w, 6) AS diff, round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS change FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prev = F.lag("value").over(w)
    return rounded(_ev(spark, d).select("event_id", F.lag("value", 2).over(w).alias("shift"), (F.col("value") - prev).alias("diff"), (F.try_divide(F.col("value"), prev) - 1).alias("change")))


@query("fea10_moving", f"{_EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS rolling, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS expanding FROM e")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _ev(spark, d).select("event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 9).alias("rolling"), F.round(F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("expanding"))


@query("fea10_ewm", f"""{_EV}, r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e)
 SELECT a.event_id, round(sum(b.value * power(0.5, a.i - b.i)) / sum(power(0.5, a.i - b.i)), 6) AS ewm FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id""")
def _(spark, d):
    return rounded(P.ewm_mean(_ev(spark, d), "value", ["user_id"], ["ts", "event_id"], 0.5).select("event_id", "ewm"))


@query("fea11_time_parts", "SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS week, count(*) AS n, round(avg(month(o_orderdate)), 6) AS month, round(avg(dayofweek(o_orderdate) + 1), 6) AS dow FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("week")).agg(F.count("*").alias("n"), F.avg(F.month("o_orderdate")).alias("month"), F.avg(F.dayofweek("o_orderdate")).alias("dow")))


@query("fea12_ranking", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE AS r, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS best FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    best = c.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))
    return P.average_rank(c, "c_acctbal", ["c_nationkey"], "r").join(F.broadcast(best), "c_nationkey").select("c_custkey", "r", "best")  # a row a nation


@query("fea13_frequency", "SELECT p_brand, count(*) AS n, count(*) - count(DISTINCT p_name) AS duplicated, count(DISTINCT p_type) AS types FROM part GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("p_name")).alias("duplicated"), F.count_distinct("p_type").alias("types"))


@query("fea14_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS c FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(_li(spark, d).groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.covar_samp("l_quantity", "l_discount").alias("c")))


@query("fea15_reshape", "SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4) AS n, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS r FROM lineitem GROUP BY 1")
def _(spark, d):
    wide = _li(spark, d).groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 4))
    return wide.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("fea16_text", "SELECT p_partkey, contains(p_name, 'red') AS red, string_split(p_name, ' ')[1] AS word, length(p_name) AS n, repeat(substr(p_type, 1, 2), 2) AS twice FROM part")
def _(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", F.col("p_name").contains("red").alias("red"), F.element_at(F.split("p_name", " "), 1).alias("word"), F.length("p_name").alias("n"), F.repeat(F.substring("p_type", 1, 2), 2).alias("twice")))


@query("fea17_categories", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code, try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS number, md5(p_type) AS hash FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    codes = range_rank(p.select("p_brand").distinct(), "p_brand", "code")
    return rounded(p.join(codes, "p_brand").select("p_partkey", "code", F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("double").alias("number"), F.md5("p_type").alias("hash")))


_PAIRS = ("l_quantity", "l_discount", "l_tax")


@query("fea20_pairwise", _sql({f"{a}_{w}_{b}": f"{a} {o} {b}" for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :] for w, o in (("plus", "+"), ("times", "*"))}))
def _(spark, d):
    df = P.pairwise(_li(spark, d), list(_PAIRS))
    return _totals(df, [c for c in df.columns if "_plus_" in c or "_times_" in c])


@query("fea21_univariate", _sql({"l_tax_sq": "l_tax * l_tax", "l_tax_cube": "l_tax * l_tax * l_tax", "l_tax_inv": "1 / nullif(l_tax, 0)", "l_tax_root": "sqrt(abs(l_tax))", "l_tax_ln": "CASE WHEN l_tax > 0 THEN ln(l_tax) END", "l_tax_abs": "abs(l_tax)"}))
def _(spark, d):
    df = P.univariate(_li(spark, d), ["l_tax"])
    return _totals(df, [c for c in df.columns if c.startswith("l_tax_")])


@query("fea22_stored_program", "WITH g AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1) SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(l_quantity / l_extendedprice), 3) AS ratio, round(sum(m), 3) AS flag_mean FROM lineitem JOIN g USING (l_returnflag) WHERE l_linenumber > 4 GROUP BY 1")
def _(spark, d):
    program = [Feature("ratio", "try_divide(l_quantity, l_extendedprice)"), Feature("flag_mean", group_by="l_returnflag", statistic="avg(l_quantity)")]
    li = _li(spark, d)
    return _totals(P.apply_program(program, li.where("l_linenumber > 4"), li.where("l_linenumber <= 4")), ["ratio", "flag_mean"])


@query("fea24_lineage", "SELECT p_partkey AS program_id, 'ratio_' || p_size AS feature, ['age', 'amount'] AS source_fields, ['np.log1p'] AS operators, sha256('df[''ratio_' || p_size || '''] = np.log1p(df[''amount'']) / (df[''age''] + 1)') AS code_sha256 FROM part")
def _(spark, d):
    code = F.concat(F.lit("df['ratio_"), "p_size", F.lit("'] = np.log1p(df['amount']) / (df['age'] + 1)"))
    return P.lineage(table(spark, d, "part").select(F.col("p_partkey").alias("program_id"), code.alias("code")))


@query("fea25_attribution", "SELECT 'f' || p_size AS feature, min(p_partkey) AS program_id FROM part WHERE p_size <= 10 GROUP BY 1")
def _(spark, d):
    code = F.concat(F.lit("df['f"), "p_size", F.lit("'] = df['x'] + 1"))
    edges = P.lineage(table(spark, d, "part").select(F.col("p_partkey").alias("program_id"), code.alias("code")))
    chosen = spark.range(1, 11).select(F.concat(F.lit("f"), "id").alias("feature"))
    return edges.join(chosen, "feature", "left_semi").groupBy("feature").agg(F.min("program_id").alias("program_id"))


@query("fsel2_f_test", "SELECT name, round(r * r / (1 - r * r) * (n - 2), 4) AS f FROM (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_tax, l_extendedprice) AS c FROM lineitem), LATERAL (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS name, unnest([a, b, c]) AS r)")
def _(spark, d):
    return P.f_test(_li(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("name", F.round("f", 4).alias("f"))


_BINS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_discount": [0.025, 0.055, 0.085]}


@query("fsel1_mutual_information", "WITH b AS (SELECT 'l_quantity' AS name, l_returnflag AS y, (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS b FROM lineitem UNION ALL SELECT 'l_discount', l_returnflag, (l_discount > 0.025)::INT + (l_discount > 0.055)::INT + (l_discount > 0.085)::INT FROM lineitem), c AS (SELECT name, b, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL), p AS (SELECT name, n, sum(n) OVER (PARTITION BY name) AS t, sum(n) OVER (PARTITION BY name, b) AS nb, sum(n) OVER (PARTITION BY name, y) AS ny FROM c) SELECT name, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi FROM p GROUP BY name")
def _(spark, d):
    return rounded(P.mutual_information(_li(spark, d), list(_BINS), "l_returnflag", _BINS))


@query("fsel3_two_means_gain", "WITH u AS (SELECT 'l_quantity' AS name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem), g AS (SELECT name, x, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS k, sum(n * x) OVER w AS s, sum(n) OVER (PARTITION BY name) AS kk, sum(n * x) OVER (PARTITION BY name) AS ss, sum(n * x * x) OVER (PARTITION BY name) AS qq FROM g WINDOW w AS (PARTITION BY name ORDER BY x)) SELECT name, round(max((s * s / k + (ss - s) * (ss - s) / (kk - k) - ss * ss / kk) / (qq - ss * ss / kk)), 6) AS gain FROM s WHERE k < kk GROUP BY name")
def _(spark, d):
    return rounded(P.split_gain(_li(spark, d), ["l_quantity", "l_discount"]))
