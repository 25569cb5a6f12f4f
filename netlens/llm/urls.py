"""URL filtering: host and path rules, and boosted trees on lexical features for the rest."""

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import staged

#: Labelled URLs that the trees are fitted on, at most (expected number; chosen by a hash).
MAX_LABELLED = 20_000
TREES, DEPTH = 12, 4
#: Weight of the overall rate in the statistics of a suffix.
PRIOR = 20.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased;
    empty for a null or a URL without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does. A rule
    (verdict, host, path) fits its host and all its subdomains if the path starts with its own;
    of rules of equal length the first listed wins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(letters), F.lit(1))
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return -F.aggregate(share, F.lit(0.0), lambda total, p: total + p * F.log2(p))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with host, path and url) and its lexical features."""
    bare = F.concat("host", "path")
    n = F.greatest(F.length(bare), F.lit(1))
    return urls.withColumns(
        {
            "f_length": F.length(F.coalesce("url", F.lit(""))).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_host_depth": F.size(F.split("host", r"\.")).cast("double"),
            "f_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
            "f_digits": F.length(F.regexp_replace(bare, "[^0-9]", "")) / n,
            "f_hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
            "f_entropy": _entropy(bare),
            "f_parameters": F.size(F.filter(F.split(_query_of(F.col("url")), "&"), lambda p: p != "")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "section": F.concat(F.substring_index("host", ".", -1), F.lit("/"), F.element_at(F.split(F.concat("path", F.lit("//")), "/"), 2)),
        }
    )


LEXICAL = ["f_length", "f_host_length", "f_host_depth", "f_depth", "f_digits", "f_hyphens", "f_entropy", "f_parameters"]
SUFFIXES = ["suffix", "domain", "section"]


class Filter:
    """Trees, the statistics of suffixes they were trained with, and on how many rows."""

    def __init__(self, model: GBTClassificationModel | None, rates: dict[str, DataFrame], base: float, sampled: int):
        self.model, self.rates, self.base, self.sampled = model, rates, base, sampled

    def vectors(self, urls: DataFrame) -> DataFrame:
        """Suffix statistics join as smoothed block rates; an unknown suffix has the base rate."""
        rows = lexical(urls)
        for name in SUFFIXES:
            rows = rows.join(self.rates[name], name, "left")
            rows = rows.withColumn(f"f_{name}", F.coalesce(f"rate_{name}", F.lit(self.base))).drop(f"rate_{name}")
        return VectorAssembler(inputCols=[*LEXICAL, *(f"f_{s}" for s in SUFFIXES)], outputCol="features").transform(rows)

    def chance(self, urls: DataFrame, to: str) -> DataFrame:
        """``urls`` with the chance of "block"."""
        names = urls.columns
        if self.model is None:
            return urls.withColumn(to, F.lit(self.base))
        scored = self.model.transform(self.vectors(urls))
        return scored.select(*names, vector_to_array("probability")[1].alias(to))


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Filter:
    """Fit on labelled URLs (url, host, path, label 1 for block, and an id if there is one): trees on
    about ``max_labelled`` rows, chosen by a hash of id and URL; suffix statistics on all rows. With
    labels of one class only, its rate is the chance of every URL; without any, 1/2."""
    sums = lexical(labelled).groupBy(*SUFFIXES).agg(F.sum(F.col("label").cast("double")).alias("blocked"), F.count("*").alias("n"))
    sums = staged(sums, "label-counts")
    counted, blocked = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    base = blocked / counted if counted else 0.5
    rates = {}
    for name in SUFFIXES:
        rate = (F.sum("blocked") + PRIOR * base) / (F.sum("n") + PRIOR)
        rates[name] = staged(sums.where(F.col(name).isNotNull()).groupBy(name).agg(rate.alias(f"rate_{name}")), f"rates-{name}")
    share = min(1.0, max_labelled / max(1, counted))
    salted = F.xxhash64(*(c for c in ("id", "url") if c in labelled.columns))
    rows = labelled.where(F.pmod(salted, F.lit(1_000_000)) < int(share * 1_000_000)).select("url", "host", "path", F.col("label").cast("double"))
    rows = staged(rows, "labelled-urls")
    kept, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    made = Filter(None, rates, base, kept)
    if 0 < blocked < kept:
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
        made.model = trees.fit(made.vectors(rows).select("features", "label"))
    return made


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per page: id, host, path, rule, score and verdict. A fitting rule decides; the
    trees, trained on the URLs that rules decide, judge the others (block at a chance of 1/2 or
    more). Null and odd URLs have empty host and path and are judged like any other; repeated
    rows stay; no rows give no rows."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, kind = ruled(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "kind": kind})
    labelled = urls.where("kind IS NOT NULL").withColumn("label", (F.col("kind") == "block").cast("int"))
    scored = train(labelled, max_labelled).chance(urls, "score")
    verdict = F.coalesce("kind", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
