"""URL filters: explicit host rules first, then association rules mined with FP-growth.

The explicit rules label the urls that they fit. FP-growth mines which token
combinations of labelled urls go with a verdict; rules pruned by support and
confidence judge the other urls through an inverted index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm.common import Written, checkpoint, table

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Mining:
    """Limits of the mined rules.

    A url is mined with all its tokens; those below min_support are in no itemset. The number of
    itemsets has no other bound: it can double with each token that frequent urls share.
    """

    min_support: float = 0.01
    min_confidence: float = 0.8
    default: str = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^[\s\S]*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels as h:..., path segments as p:..., digits as #; each once, sorted."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(F.lower(path), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, parts), lambda x: F.length(x) > 2)))


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """antecedent array<string>, verdict, confidence, support, bound (of the confidence) from distinct labelled urls.

    labelled has url, tokens, verdict. Copies of a url count once, so a group of copies can't make
    a rule. A rule is pruned unless its confidence beats that of every smaller rule
    with part of its tokens and the same verdict. Without labelled urls: no rules.
    """
    spark = labelled.sparkSession
    urls = labelled.filter(F.size("tokens") > 0).select("url", "tokens", "verdict").distinct()
    kept = urls.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    kept = checkpoint(kept)
    if kept.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, bound double")
    model = FPGrowth(
        itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence
    ).fit(kept)
    found = model.associationRules.filter(
        F.col("consequent")[0].startswith("verdict:")
        & ~F.exists("antecedent", lambda x: x.startswith("verdict:"))
    ).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring(F.col("consequent")[0], 9, 99).alias("verdict"),
        "confidence",
        "support",
    )
    found = checkpoint(found.withColumn("bound", lower_bound(F.col("confidence"), F.col("support") / F.col("confidence") * kept.count())))
    # Every smaller antecedent is looked up; all of them are frequent, so there are no more than itemsets of this one.
    start = F.array(F.array().cast("array<string>"))
    parts = F.aggregate("antecedent", start, lambda some, x: F.concat(some, F.transform(some, lambda s: F.concat(s, F.array(x)))))
    asked = found.select("antecedent", "verdict", "confidence", F.explode(parts).alias("part")).filter(
        (F.size("part") > 0) & (F.size("part") < F.size("antecedent"))
    )
    smaller = found.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("c"))
    covered = asked.join(smaller, ["part", "verdict"]).filter("c >= confidence").select("antecedent", "verdict").distinct()
    return found.join(covered, ["antecedent", "verdict"], "left_anti")


def lower_bound(share: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of a share that was seen n times: what few urls say counts less."""
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens array<string> -> mined struct<bound, size, verdict, confidence>, for the arrays that a rule fits.

    Inverted index: a rule is filed under its rarest token among the rules, so an
    array meets a rule at most once. The best has the highest lower bound of its confidence, so
    of rules with one confidence that with the larger support; then the most tokens, then the verdict later in the alphabet.
    """
    filed = rules.withColumn("id", F.xxhash64("antecedent", "verdict"))
    each = filed.select("id", F.explode("antecedent").alias("token"))
    use = each.groupBy("token").agg(F.count("*").alias("n"))
    entry = each.join(use, "token").groupBy("id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = filed.join(entry, "id").select("token", "antecedent", "verdict", "confidence", F.round("bound", 12).alias("bound"))
    fits = (
        tokens.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max(F.struct("bound", F.size("antecedent").alias("size"), "verdict", "confidence"))
    return fits.groupBy("tokens").agg(best.alias("mined"))


def judge_urls(pages: DataFrame, mining: Mining = Mining(), rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined for every row of pages (page_id, url).

    Null, empty and repeated urls keep their rows; a url without tokens gets the default verdict.
    Other columns of pages are ignored. Very long urls are mined and
    matched whole. Distinct token sets are matched once, so copies cost nothing.
    """
    host, path = split_url(F.col("url"))
    parted = (
        pages.select("page_id", "url")
        .withColumns({"host": host, "path": path})
        .withColumns({"found": explicit_rule(F.col("host"), F.col("path"), rules), "tokens": url_tokens(F.col("host"), F.col("path"))})
    )
    labelled = parted.filter(F.col("found").isNotNull()).select("url", "tokens", F.col("found.verdict").alias("verdict"))
    open_ = parted.filter(F.col("found").isNull()).select("tokens").distinct()
    # Written, so that its size is known: many urls may share a token set, and their join must be splittable.
    mined = Written(pages.sparkSession).table(match_rules(open_, mine_rules(labelled, mining)))
    known = parted.filter(F.col("found").isNotNull()).withColumn("mined", F.lit(None).cast(mined.schema["mined"].dataType))
    unknown = parted.filter(F.col("found").isNull()).join(mined, "tokens", "left")
    columns = ["page_id", "host", "path", "found", "mined"]
    return (
        known.select(*columns)
        .unionByName(unknown.select(*columns))
        .select(
            "page_id",
            "host",
            "path",
            F.col("found.rule").alias("rule"),
            F.coalesce("found.verdict", "mined.verdict", F.lit(mining.default)).alias("verdict"),
            F.col("mined.confidence").alias("confidence"),
        )
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
