"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame functions and Spark's own MLlib; no Python on the executors.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the trees like any other. Repeated rows are judged alike. An empty table gives no rows. Other
columns of the input are ignored. If all labelled URLs share one label, that label is the verdict.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: (verdict, host, path) of a rule: it fits the host and its subdomains, below the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a host that label a URL as bad where no rule does: the subjects of public block lists. They stand in for labels,
#: which the given tables do not have; a caller with labelled URLs passes those.
BAD_TERMS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: At most so many labelled URLs of each label are fitted, those of the smallest hash.
FIT_ROWS = 5000
#: Suffix statistics of a URL leave out the labels of the hosts of its fold, so never hold its own.
FOLDS = 5
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens", "longest_label", "suffix_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for null or no ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, rest, 1)), F.regexp_extract(url, rest, 2)


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct<rule, verdict>, else null. ``rules`` is a list of the driver's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        out = F.when(fits, F.struct(F.lit(at + below).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features of ``_url`` with ``_host`` and ``_path``; all but the suffix statistics."""
    url = F.coalesce("_url", F.lit(""))
    n = F.length(url)
    chars = F.split(url, "")
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))
    )
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("_host", r"\.")
    return pages.select(
        "*",
        n.cast("double").alias("length"),
        F.length("_host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("_path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0).alias("digit_ratio"),
        F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        F.size(labels).cast("double").alias("labels"),
        (F.length("_host") - F.length(F.replace(F.col("_host"), F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        F.element_at(labels, -1).alias("_suffix"),
    )


def fold() -> Column:
    """All URLs of a host are in one fold."""
    return F.pmod(F.xxhash64("_host"), F.lit(FOLDS)).cast("int")


def stand_in_labels(urls: DataFrame) -> DataFrame:
    """Labels of URLs with a host (_url, _host, _path, _rule): the rule's verdict, else whether the host has one of BAD_TERMS as a word."""
    bad = F.arrays_overlap(F.split("_host", r"[.-]"), F.array(*map(F.lit, BAD_TERMS)))
    label = F.when(F.col("_rule").isNotNull(), F.col("_rule.verdict") == "block").otherwise(bad)
    return urls.where(F.col("_host") != "").select("_url", "_host", "_path", label.cast("double").alias("_label"))


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, *, fit_rows: int = FIT_ROWS, trees: int = 12, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score (chance of ``block``) for every page.

    labels: ``url, label`` (1 is bad) to train on; by default the pages' ``stand_in_labels``. At most ``fit_rows`` of each label are
    fitted, which bounds the work of training; the suffix statistics count all labelled URLs but those of the hosts of a URL's own fold.
    """
    host, path = parts(F.col("url"))
    base = pages.select("page_id", F.col("url").alias("_url"), host.alias("_host"), path.alias("_path"))
    base = base.withColumn("_rule", first_rule(F.col("_host"), F.col("_path"), rules))
    if labels is None:
        known = stand_in_labels(base)
    else:
        host, path = parts(F.col("url"))
        known = labels.select(F.col("url").alias("_url"), host.alias("_host"), path.alias("_path"), F.col("label").cast("double").alias("_label")).where("_label is not null")
    every = lexical(base)
    # Counts by suffix and fold; a fold's rate is that of the others, smoothed towards an even chance.
    counts = known.groupBy(F.element_at(F.split("_host", r"\."), -1).alias("_suffix"), fold().alias("_fold")).agg(F.sum("_label").alias("_bad"), F.count("*").alias("_n"))
    counts = cut(counts)
    total = counts.agg(F.sum("_bad").alias("bad"), F.sum("_n").alias("n")).first()
    bad, n = total["bad"] or 0, total["n"] or 0
    whole = counts.groupBy("_suffix").agg(F.sum("_bad").alias("_bads"), F.sum("_n").alias("_ns")).withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    other = [F.col(f"_{c}s") - F.coalesce(f"_{c}", F.lit(0)) for c in ("bad", "n")]
    rates = cut(whole.join(counts, ["_suffix", "_fold"], "left").select("_suffix", "_fold", ((other[0] + 1) / (other[1] + 2)).alias("suffix_rate")))

    def rated(df: DataFrame) -> DataFrame:
        return df.withColumn("_fold", fold()).join(rates, ["_suffix", "_fold"], "left").fillna(0.5, ["suffix_rate"])

    if 0 < bad < n:
        fitted = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_url"), "_url").limit(fit_rows) for y in (0.0, 1.0)]
        made = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector")
        model = GBTClassifier(featuresCol="_vector", labelCol="_label", maxIter=trees, maxDepth=depth, seed=7)
        fit_on = rated(lexical(fitted[0].unionByName(fitted[1]))).coalesce(1)
        scored = model.fit(made.transform(fit_on)).transform(made.transform(rated(every)))
        score = vector_to_array("probability")[1]
    else:
        scored, score = every, F.lit(1.0 if bad else 0.0)
    return scored.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.round(score, 6).alias("score"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filters": op7_url_filters}
