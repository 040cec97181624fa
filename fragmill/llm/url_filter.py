"""URL filter: fixed host and path rules, and association rules mined from labels.

Operator 9. A fixed rule fits its host and all subdomains, where the path starts with the rule's; the longest wins. For
other URLs, Spark's FP-growth mines combinations of URL tokens from labelled pages (a page is bad where ``labels`` has
quality 0 or toxic 1 for its id); combinations that imply a bad page with enough confidence and support are kept if no
part of them does as well, and matched by an inverted index: each rule is filed under its rarest token, and a page is
compared only with the rules filed under one of its own tokens.

All tokens of a URL are mined, but a counted pass first leaves out what can't change the rules: tokens in too few bad
pages; all but one of tokens that are in the same labelled pages (a class; a page with any of them has the class); and
tokens that only bad pages have, each of which is a rule that no combination betters. All rules left are matched.

At most about TRAIN_PAGES labelled pages are mined, chosen by a hash of their id. Null url, or one without ``://``: host and path empty, no rule, allowed. Where no
combination reaches the bounds, nothing is blocked beyond the fixed rules. Repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import materialise

#: Fixed rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRAIN_PAGES = 200_000
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 15, 0.6
BAD = "//bad"


def parsed(url: str = "url") -> tuple[Column, Column]:
    """(host, path) of a URL: the host A-Z lower-cased; both empty for null or without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, F.lit("://"))
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(df: DataFrame) -> DataFrame:
    """``df`` (host, path) with rule and rule_verdict of the longest fixed rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def tokens() -> Column:
    """Distinct tokens of host labels and path parts, digits as 0, marked by where they stand."""
    host = F.transform(F.array_remove(F.split("host", r"\."), ""), lambda x: F.concat(F.lit("h:"), x))
    hyphened = F.transform(F.array_remove(F.split("host", r"[.-]"), ""), lambda x: F.concat(F.lit("w:"), x))
    path = F.transform(F.array_remove(F.split(F.lower("path"), r"[^a-z0-9]+"), ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.concat(host, hyphened, path))


def _pruned(implied: DataFrame) -> DataFrame:
    """``implied`` (antecedent, sorted, and confidence) without those of which a part is as confident."""
    a = implied.select(F.col("antecedent").alias("whole"), F.col("confidence").alias("reached"), F.explode("antecedent").alias("filed"))
    b = implied.select("antecedent", "confidence", F.col("antecedent")[0].alias("filed"))
    part = (F.size("antecedent") < F.size("whole")) & (F.col("confidence") >= F.col("reached")) & (F.size(F.array_except("antecedent", "whole")) == 0)
    gone = a.join(b, "filed").where(part).select(F.col("whole").alias("antecedent")).distinct()
    return implied.join(gone, "antecedent", "left_anti")


def mine(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pruned rules that imply a bad page (antecedent array<string>, confidence, support), and the classes of their tokens (token, item)."""
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    n = bad.count()
    some = bad.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, -(-n // TRAIN_PAGES)))) == 0)
    baskets = materialise(pages.select("page_id", "tokens").dropDuplicates(["page_id"]).join(some, "page_id"), "url-baskets")
    total = baskets.count()
    no_rules = spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    if not total:
        return no_rules, spark.createDataFrame([], "token string, item string")
    least = math.ceil(min(1.0, max(MIN_SUPPORT, MIN_COUNT / total)) * total)

    held = baskets.select("page_id", "bad", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(
        F.count("*").alias("n"),
        F.count_if("bad").alias("n_bad"),
        F.bit_xor(F.xxhash64("page_id")).alias("one"),
        F.bit_xor(F.xxhash64("page_id", F.lit(1))).alias("two"),
    ).where(F.col("n_bad") >= least)
    same = ["n", "n_bad", "one", "two"]
    classes = counts.join(counts.groupBy(*same).agg(F.min("token").alias("item")), same)
    classes = materialise(classes.select("token", "item", "n", "n_bad"), "url-classes")

    items = classes.where("token = item")
    certain = items.where("n = n_bad").select(F.array("item").alias("antecedent"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    open_ = held.join(items.where("n > n_bad").select("token"), "token").groupBy("page_id", "bad").agg(F.collect_set("token").alias("items"))
    open_ = materialise(open_.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "url-items")
    m, implied = open_.count(), no_rules
    if m:
        # half a page below, so that rounding can't raise the count
        model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / m), minConfidence=MIN_CONFIDENCE).fit(open_) if least <= m else None
        if model:
            rules = model.associationRules.where(F.col("consequent")[0] == BAD)
            rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * m / total).alias("support"))
            implied = _pruned(materialise(rules, "url-implied"))
    return materialise(implied.unionByName(certain), "url-rules"), classes.select("token", "item")


def _matching(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``urls`` (host, path, tokens; distinct) that a rule fits: (host, path)."""
    parts = rules.select("antecedent", F.explode("antecedent").alias("item"))
    rarity = parts.groupBy("item").agg(F.count("*").alias("c"))
    filed = parts.join(rarity, "item").groupBy("antecedent").agg(F.min(F.struct("c", "item")).alias("rarest")).select("antecedent", F.col("rarest.item").alias("filed"))
    telling = classes.join(rarity.select("item"), "item")
    held = urls.select("host", "path", F.explode("tokens").alias("token")).join(telling, "token").groupBy("host", "path").agg(F.collect_set("item").alias("items"))
    candidates = held.select("host", "path", "items", F.explode("items").alias("filed")).join(filed, "filed")
    return candidates.where(F.size(F.array_except("antecedent", "items")) == 0).select("host", "path").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    host, path = parsed()
    df = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))).withColumn("tokens", tokens())
    rules, classes = mine(df, labels)
    matched: Column = F.lit(False)
    if not rules.isEmpty():
        hits = _matching(df.where("rule is null").select("host", "path", "tokens").distinct(), rules, classes)
        df = df.join(hits.withColumn("hit", F.lit(True)), ["host", "path"], "left")
        matched = F.coalesce("hit", F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(matched, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
