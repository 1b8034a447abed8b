"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for URLs that no rule decides."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, table, written

#: The rules, as (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "has_fragment", "suffix_length", "suffix_share", "suffix_hosts")


def parts(url: str = "url") -> dict[str, Column]:
    """host, path and query of a URL column; all empty without "://" or for null."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"host": F.translate(host, upper, upper.lower()), "path": path, "query": F.regexp_extract(tail, "^[^?#]*[?]([^#]*)", 1)}


def rule_column(rules=RULES, action: bool = False) -> Column:
    """The longest fitting rule (or its action), null if none fits: its host or a subdomain, and a path that starts with its path."""
    out = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(kind if action else host + path)).otherwise(out)
    return out


def _entropy(name: str) -> Column:
    share = f"transform(array_distinct(split({name}, '')), c -> (length({name}) - length(replace({name}, c, ''))) / cast(length({name}) as double))"
    return F.when(F.length(name) > 0, F.expr(f"aggregate(filter({share}, p -> p > 0), 0D, (s, p) -> s - p * log2(p))")).otherwise(0.0)


def _digits(name: str) -> Column:
    return F.when(F.length(name) > 0, F.length(F.regexp_replace(name, "[^0-9]", "")) / F.length(name)).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, query) with FEATURES; suffix statistics count all rows, and join by suffix."""
    known = urls.withColumn("_url", F.coalesce("url", F.lit(""))).withColumn("_suffix", F.regexp_extract("host", "[^.]*$", 0))
    stats = known.groupBy("_suffix").agg(F.count("*").alias("_n"), F.approx_count_distinct("host").alias("_hosts"))
    total = stats.agg(F.sum("_n").alias("_total"))  # one row
    stats = stats.crossJoin(F.broadcast(total)).withColumn("suffix_share", F.log1p(F.col("_n")) - F.log1p(F.col("_total")))
    stats = stats.withColumn("suffix_hosts", F.log1p(F.col("_hosts").cast("double"))).select("_suffix", "_n", "suffix_share", "suffix_hosts")
    joined = attach(known, stats, ["_suffix"], "_n").drop("_n")
    return joined.withColumns({
        "url_length": F.length("_url"), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "labels": F.size(F.split("host", "[.]")),
        "digit_ratio": _digits("_url"), "host_digit_ratio": _digits("host"), "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "entropy": _entropy("_url"), "host_entropy": _entropy("host"), "parameters": F.size(F.filter(F.split("query", "&"), lambda x: x != "")),
        "has_fragment": F.contains(F.col("_url"), F.lit("#")).cast("int"), "suffix_length": F.length("_suffix"),
    }).drop("_url", "_suffix")


def judge(pages: DataFrame, rules=RULES, most: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 1) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row.

    The labelled URLs are those that a rule decides; at most `most` distinct ones, of the least hash, train the trees.
    Without both actions among them, the action there is (or allow) holds for the rest. Null, empty and very long
    URLs have features like any other; equal rows get equal verdicts; other columns are ignored; an empty table gives
    no rows.
    """
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns(parts()).withColumn("rule", rule_column(rules)).withColumn("action", rule_column(rules, action=True))
    featured = written(lexical(parsed).drop("query"), "url-features")
    sample = featured.where("rule is not null").dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(most)
    sample = written(sample.select(*FEATURES, (F.col("action") == "block").cast("double").alias("label")), "url-sample")
    classes = [r[0] for r in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        scored = featured.withColumn("block_score", F.lit(classes[0] if classes else 0.0))
    else:
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(gather.transform(sample))
        scored = model.transform(gather.transform(featured)).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("action", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
