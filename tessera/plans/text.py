"""Text, JSON and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.plans.base import MULTI_SQL, PRED_SQL, multiclass, predictions, query, rounded, table
from tessera.sources import files
from tessera.sources.shared import fresh_dir


@query("flt4_banned_patterns", f"SELECT doc_id, len(regexp_extract_all(text, '(er|st)ing\\b')) AS hits FROM documents WHERE regexp_matches(text, '(er|st)ing\\b')")
def _(spark, d):
    pattern = r"(er|st)ing\b"
    return rounded(table(spark, d, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hits")))


@query("flt5_target_leak", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\b' || role || '\\b') OR contains(lower(text), 'label') OR contains(text, ' tion')")
def _(spark, d):
    c = table(spark, d, "conversations")
    own = F.expr(r"text rlike concat('\\b', role, '\\b')")
    return c.where(own | F.contains(F.lower("text"), F.lit("label")) | F.contains("text", F.lit(" tion"))).select("conv_id", "turn")


@query("flt6_text_rules", """SELECT doc_id, 'token_assignment' AS rule, unnest(regexp_extract_all(text, 'token = "[0-9a-f]{8,}')) AS hit FROM documents
 UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+\\.com')) FROM documents UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\\+1 \\(\\d{3}\\) \\d{3}-\\d{4}')) FROM documents""")
def _(spark, d):
    # a text without what every match holds needs no search
    hits = lambda n, p: F.when(F.contains("text", F.lit(X.TEXT_HINTS[n])), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.array(*[F.struct(F.lit(n).alias("rule"), hits(n, p).alias("hits")) for n, p in X.TEXT_RULES.items()])
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.rule", F.explode("x.hits").alias("hit"))


@query("str1_clean_code", "SELECT conv_id, turn, md5(regexp_replace(text, 'ou', 'xx', 'g')) AS code FROM conversations")
def _(spark, d):
    fenced = F.concat(F.lit("Here it is:\n```python\nimport re\n"), F.regexp_replace("text", "ou", "xx"), F.lit("\n```<end>"))
    c = table(spark, d, "conversations").select("conv_id", "turn", fenced.alias("text"))
    code = F.regexp_replace(X.clean_code("text"), r"^import re\n|\n$", "")
    return c.select("conv_id", "turn", F.md5(code).alias("code"))


@query("str2_without_thoughts", "SELECT conv_id, turn, md5('<b>' || text) AS text FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("<think>why\nnot</think><b>"), "text"))
    return c.select("conv_id", "turn", F.md5(X.without_thoughts("text")).alias("text"))


@query("str3_drop_lines", """SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)token|idiot') AND NOT starts_with(x, '###')), chr(10))) AS text FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.drop_lines("text", ("token", "idiot"))).alias("text"))


@query("str4_compact_messages", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
 SELECT conv_id, turn, role, md5(right(text, 200)) AS tail FROM r WHERE a = 1 OR b <= 3""")
def _(spark, d):
    w = Window.partitionBy("conv_id")
    r = table(spark, d, "conversations").withColumn("a", F.row_number().over(w.orderBy("turn"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("turn"))))
    return r.where("a = 1 or b <= 3").select("conv_id", "turn", "role", F.md5(F.right("text", F.lit(200))).alias("tail"))



@query("str5_log_metrics", "SELECT o_orderkey, ('0.' || (o_custkey % 900 + 100))::DOUBLE AS auc, (o_custkey % 100)::DOUBLE AS acc FROM orders")
def _(spark, d):
    log = F.concat(F.lit("run "), "o_orderkey", F.lit(" AUC: 0."), F.col("o_custkey") % 900 + 100, F.lit(" ACC="), F.col("o_custkey") % 100, F.lit(" done"))
    o = table(spark, d, "orders").select("o_orderkey", log.alias("body"))
    number = lambda label: F.regexp_extract("body", label + r"\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return o.select("o_orderkey", number("AUC").alias("auc"), number("ACC").alias("acc"))


@query("str6_percent", "SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(CASE WHEN abs(l_quantity * 0.05) <= 1.5 THEN l_quantity * 0.05 * 100 ELSE l_quantity * 0.05 END), 4) AS pct FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum(X.percent(F.col("l_quantity") * 0.05)), 4).alias("pct")))


@query("str7_name_alias", "SELECT p_partkey, CASE lower(trim(' ' || p_brand)) WHEN 'brand#1' THEN 'first' WHEN 'brand#2' THEN 'second' ELSE lower(p_brand) END AS name FROM part")
def _(spark, d):
    alias = F.create_map(*map(F.lit, ("brand#1", "first", "brand#2", "second")))
    key = F.lower(F.trim(F.concat(F.lit(" "), "p_brand")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(alias, key), key).alias("name"))


_CELLS = "SELECT o_orderkey, (o_custkey % 90 / 100.0)::DOUBLE * -1 + 0.0 AS mean, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.02 END::DOUBLE AS std FROM orders"


@query("str8_mean_std_cells", _CELLS)
def _(spark, d):
    cell = F.concat(F.lit("−"), F.format_string("%.2f", F.col("o_custkey") % 90 / F.lit(100.0)), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("±0.02"))
    o = table(spark, d, "orders").select("o_orderkey", cell.alias("cell"))
    mean, std = X.mean_std("cell")
    return o.select("o_orderkey", mean.alias("mean"), std.alias("std"))


@query("str8_mean_std_cells_whole", _CELLS)
def _(spark, d):
    """Every order, those of a zero mean (a cell of −0.00) too; tested by brute force besides."""
    cell = F.concat(F.lit("−"), F.format_string("%.2f", F.col("o_custkey") % 90 / F.lit(100.0)), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("±0.02"))
    mean, std = X.mean_std("cell")
    return table(spark, d, "orders").select("o_orderkey", cell.alias("cell")).select("o_orderkey", mean.alias("mean"), std.alias("std"))


@query("str9_safe_float", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value END AS v, round(CASE WHEN abs(value - 5) >= 1e-12 THEN 1 / (value - 5) END, 6) AS ratio, event_id % 4 = 2 AS yes FROM events")
def _(spark, d):
    words = F.element_at(F.array(F.lit("N/A"), F.lit(" Yes "), F.lit("")), (F.greatest(F.col("event_id") % 4, F.lit(1))).cast("int"))
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).otherwise(words).alias("t"))
    gap = F.col("value") - 5
    return e.select("event_id", X.safe_float("t").alias("v"), F.round(F.when(F.abs(gap) >= 1e-12, 1 / gap), 6).alias("ratio"), X.truthy("t").alias("yes"))


@query("str10_value_list", "SELECT o_orderkey, round(list_sum([o_custkey / 10.0::DOUBLE, 0.5]), 6) AS total, 2::BIGINT AS n FROM orders")
def _(spark, d):
    text = F.concat(F.lit("["), F.col("o_custkey") / 10, F.lit(", 0.5]"))
    v = X.value_list("t")
    return rounded(table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(v).alias("n")))


@query("str11_safe_name", "SELECT DISTINCT p_name, regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_name", X.safe_name("p_name").alias("safe")).distinct()


@query("str12_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short_hash("text").alias("h"))


@query("str13_rename_first", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS renamed FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_type", "^([^AEIOU]*)[AEIOU]", "$1_").alias("renamed"))


@query("str14_job_number", "SELECT c_custkey, regexp_extract(c_name, '(\\d+)$', 1)::BIGINT AS job_no, CASE WHEN c_mktsegment LIKE 'A%' THEN 'auto' WHEN c_mktsegment LIKE '%H%' THEN 'house' ELSE 'other' END AS route FROM customer")
def _(spark, d):
    s = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").alias("job_no"), F.when(s.startswith("A"), "auto").when(s.contains("H"), "house").otherwise("other").alias("route"))


@query("str15_embedded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    prose = F.concat(F.lit("The answer is\n"), "props", F.lit(" as asked."))
    e = table(spark, d, "events").select("event_id", prose.alias("t"))
    return e.select("event_id", F.from_json(X.embedded_json("t"), "k long")["k"].alias("k"))


@query("str16_truncate", "SELECT doc_id, md5(substr(text, 1, 120)) AS head FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 120)).alias("head"))


@query("str17_display_repair", "SELECT c_custkey, round(c_acctbal::DECIMAL(18, 6), 1)::DOUBLE AS c_acctbal, c_nationkey || '.5±' || c_custkey AS cell FROM customer")
def _(spark, d):
    """Ties go away from zero, in decimals, in both engines."""
    c = table(spark, d, "customer").withColumn("cell", F.concat(F.col("c_nationkey").cast("string"), F.lit(".5?"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", X.half_up("c_acctbal", 1).alias("c_acctbal"), X.repaired("cell").alias("cell"))


@query("str17_display_repair_whole", "SELECT c_custkey, round(c_acctbal::DECIMAL(18, 6), 1)::DOUBLE AS c_acctbal, c_acctbal || '±' || c_nationkey || ' ' || c_name || '?' AS cell FROM customer")
def _(spark, d):
    """Every customer, rounding ties too, with a cell of its own columns."""
    c = table(spark, d, "customer").withColumn("cell", F.concat(F.col("c_acctbal").cast("string"), F.lit("?"), F.col("c_nationkey").cast("string"), F.lit(" "), "c_name", F.lit("?")))
    return c.select("c_custkey", X.half_up("c_acctbal", 1).alias("c_acctbal"), X.repaired("cell").alias("cell"))


@query("fn1_logit_sigmoid", f"WITH {PRED_SQL} SELECT row_id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS z, round(p, 6) AS back FROM pred")
def _(spark, d):
    z = X.logit(F.col("p"))
    return rounded(predictions(spark, d).select("row_id", z.alias("z"), X.sigmoid(z).alias("back")))


@query("fn1_softmax", f"WITH {MULTI_SQL} SELECT row_id, round(exp(pf / 2) / (exp(pf / 2) + exp(po / 2) + exp(pp / 2)), 6) AS f FROM multi")
def _(spark, d):
    return rounded(multiclass(spark, d).select("row_id", X.softmax(F.array("pf", "po", "pp"), 2.0)[0].alias("f")))


@query("fn2_finite_probability", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1 - 1e-6 WHEN 2 THEN 1e-6 ELSE 0.25 END::DOUBLE AS p FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    p = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(0.25)
    return table(spark, d, "orders").select("o_orderkey", X.finite_probability(p).alias("p"))


@query("fn3_align_classes", f"WITH {MULTI_SQL} SELECT row_id, round(pf / (pf + po + 1 / 3.0::DOUBLE), 6) AS f, round((1 / 3.0::DOUBLE) / (pf + po + 1 / 3.0::DOUBLE), 6) AS p FROM multi")
def _(spark, d):
    aligned = X.align_classes(F.create_map(F.lit("F"), "pf", F.lit("O"), "po"), ["F", "O", "P"])
    return rounded(multiclass(spark, d).select("row_id", aligned.alias("a")).select("row_id", F.col("a")[0].alias("f"), F.col("a")[2].alias("p")))


@query("fn4_arg_max", f"WITH {MULTI_SQL} SELECT row_id, CASE WHEN pf >= po AND pf >= pp THEN 'F' WHEN po >= pp THEN 'O' ELSE 'P' END AS label FROM multi")
def _(spark, d):
    return multiclass(spark, d).select("row_id", X.arg_max(F.array("pf", "po", "pp"), ["F", "O", "P"]).alias("label"))


@query("snk5_checksums", "SELECT doc_id % 20 AS k, strlen(x) AS length, sha256(x) AS sha256 FROM (SELECT doc_id % 20 AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS x FROM documents GROUP BY 1)")
def _(spark, d):
    """Documents written as one text file for each rest of the id by 20, and every file's length and checksum."""
    path = fresh_dir(spark, "texts")
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 20).alias("k"), "text")
    docs.repartition("k").sortWithinPartitions("k", "doc_id").select("k", "text").write.partitionBy("k").text(path)
    return files.checksums(spark, path, "*.txt").select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("long").alias("k"), "length", "sha256")


@query("src11_log_scan", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def _(spark, d):
    return rounded(table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")))
