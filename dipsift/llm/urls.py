"""URL filter: rules first, then gradient-boosted trees on lexical features, in
DataFrame expressions only.

A rule is (host, path, verdict) and fits its host and all subdomains if the
url's path starts with the rule's; the longest wins.  Urls that no rule fits are
judged by trees trained on labelled urls (here: those the rules decide).

A url that is null or has no ``://`` has an empty host and path, fits no rule and
is judged like others, from what its text shows.  Repeated rows are judged
alike.  Without labelled urls of both verdicts everything undecided is
allowed.  Empty tables give empty results; all columns pass through, and those named like an appended one are replaced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.llm.common import weighted_sample
from dipsift.operators.lineage import materialise
from dipsift.operators.skew import attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "entropy", "hyphens", "params", "has_query",
            "has_fragment", "secure", "longest_label", "ends_in_slash", "has_extension", "vowel_ratio", "suffix_share", "suffix_blocked")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def part(c):
        share = (n - F.length(F.replace(text, c))) / n
        return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(part(c)))


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, what, ""))).cast("double")


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def lexical(pages: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """Append the features; ``suffixes`` has (_suffix, _share of labelled urls, _blocked share), each suffix once."""
    pages = attach(pages.withColumn("_suffix", suffix_of(F.col("host"))), suffixes, ["_suffix"], [url])
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    long = F.greatest(F.length(text), F.lit(1))
    made = {
        "length": F.length(text), "host_length": F.length(host), "path_length": F.length(path), "labels": F.size(F.split(host, r"\.")),
        "depth": _count(path, "/"), "digit_ratio": _count(text, "[0-9]") / long, "host_digits": _count(host, "[0-9]"), "entropy": _entropy(text),
        "hyphens": _count(host, "-"), "params": _count(F.regexp_extract(text, r"(?s)\?(.*)", 1), "="), "has_query": F.contains(text, F.lit("?")),
        "has_fragment": F.contains(text, F.lit("#")), "secure": F.startswith(text, F.lit("https")),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), "ends_in_slash": F.endswith(path, F.lit("/")),
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"), "vowel_ratio": _count(host, "[aeiouy]") / F.greatest(F.length(host), F.lit(1)),
        "suffix_share": F.coalesce("_share", F.lit(0.0)), "suffix_blocked": F.coalesce("_blocked", F.lit(0.5)),
    }
    return pages.withColumns({f"_{k}": v.cast("double") for k, v in made.items()})


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None  # over all labelled urls


def fit(labelled: DataFrame, url: str = "url", per_verdict: int = 3000, rounds: int = 20, depth: int = 4) -> UrlModel:
    """Learn from rows with ``host``, ``path`` and ``verdict`` (allow or block): about
    ``per_verdict`` rows of each (a bounded sample; the bound is this parameter), equal urls
    as one row with a weight.  Suffixes are counted over all rows."""
    rows = weighted_sample(labelled.select(url, "host", "path", "verdict"), [url, "host", "path"], "verdict", per_verdict).coalesce(4)
    if rows.select("verdict").distinct().count() < 2:
        return UrlModel(None, None)
    found = materialise(labelled.groupBy(suffix_of(F.col("host")).alias("_suffix")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("verdict") == "block").cast("double")).alias("b")), "suffix-counts")
    total = found.agg(F.sum("n")).first()[0]
    suffixes = materialise(found.select("_suffix", (F.col("n") / total).alias("_share"), ((F.col("b") + 1.0) / (F.col("n") + 2.0)).alias("_blocked")), "suffixes")
    inputs = [f"_{x}" for x in FEATURES]
    ready = VectorAssembler(inputCols=inputs, outputCol="_features").transform(lexical(rows, url, suffixes)).select(
        "_features", (F.col("verdict") == "block").cast("double").alias("_label"), "weight")
    return UrlModel(GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=7).fit(ready.cache()), suffixes)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", **limits) -> DataFrame:
    """Append host, path, rule, verdict and score (of blocking, by the trees)."""
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "verdict": verdict})
    model = fit(rows.where(F.col("verdict").isNotNull()), url, **limits)
    if model.trees is None:
        return rows.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).withColumn("score", F.lit(0.0))
    ready = VectorAssembler(inputCols=[f"_{x}" for x in FEATURES], outputCol="_features").transform(lexical(rows, url, model.suffixes))
    scored = model.trees.transform(ready).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(*[F.col(f"`{c}`") for c in rest], "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")
