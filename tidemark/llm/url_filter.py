"""URL filtering: rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only.

A rule is (host, path, verdict); it fits its host and all subdomains when the url's path starts with the rule's, and the
longest rule wins. Features are lengths, depth, digit ratio, character entropy, parameter counts and how often labelled
urls with the same last host labels are blocked.

The trees learn from all different labelled urls, both classes weighed alike. The limit of `block` is where the mean of both
error rates is least among the scores of all these urls, each by trees that learnt without its fold of FOLDS. The suffix
statistics that a labelled url is trained or scored with leave its own fold out, so they can't tell its label.

Features are cut into bins of about as many urls each, by counts of all their values (ratios in thousandths), and go to the
trees as the bins' numbers. Spark's trees would take the thresholds of plain numbers from a sample of 10,000 rows; those of
bins come from sums over all rows.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is judged by the trees like any
other; a very long url costs time in proportion to its length and its number of different characters; with labels of one
class only, that class is the verdict for all; without labels, `allow`. Where no fold can be scored by trees that learnt
from both classes without it, the limit is 0.5. Repeated rows are judged alike and train once; ties of the limit go to the
lower one. An empty table gives an empty result; columns named as a result (host, path, rule, verdict, block_score) are
replaced, others are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, forget, quoted, small

BLOCK, ALLOW = "block", "allow"
TREES, DEPTH, FOLDS = 12, 4, 5
#: A feature has at most so many bins (Spark's trees take 32), of so many urls or more each, as far as equal values can be parted.
BINS, BIN_URLS = 32, 50
#: How many models are grown side by side.
GROWN = 2
#: Training urls are written in parts of about so many rows.
PART_URLS = 50_000
#: How many labels of the prior a suffix starts from.
PRIOR_WEIGHT = 5
#: Suffix statistics of at most so many rows are broadcast.
BROADCAST_SUFFIXES = 200_000
FEATURES = ("n_url", "n_host", "n_path", "depth", "digits", "entropy", "params", "query", "fragment", "dots", "dashes", "host_digits", "longest_part", "rate_1", "rate_2")
#: Features that are no counts.
RATIOS = ("digits", "entropy", "rate_1", "rate_2")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    after = F.substring_index(rest_of(url), "/", 1)
    return F.translate(F.regexp_extract(after, r"(?s)^([^?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(rest_of(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """df with the lexical features of its urls and the host's last one and two labels."""
    u, h, p = F.coalesce(quoted(url), F.lit("")), quoted(host), quoted(path)
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    share = F.transform(F.array_distinct(chars), lambda c: (F.length(u) - F.length(F.replace(u, c))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what)))).cast("double")
    new = {
        "n_url": F.length(u), "n_host": F.length(h), "n_path": F.length(p), "depth": count(p, "/"),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n, "entropy": entropy,
        "params": F.when(query != "", count(query, "&") + 1).otherwise(0.0), "query": F.length(query), "fragment": F.contains(u, F.lit("#")).cast("double"),
        "dots": count(h, "."), "dashes": count(u, "-"), "host_digits": F.length(F.regexp_replace(h, "[^0-9]", "")),
        "longest_part": F.array_max(F.transform(F.split(p, "/"), F.length)),
    }
    return df.withColumns({f"__{k}": v.cast("double") for k, v in new.items()} | {"__last_1": F.substring_index(h, ".", -1), "__last_2": F.substring_index(h, ".", -2)})


def suffix_statistics(known: DataFrame) -> DataFrame:
    """(part, suffix, sums, counts) of labelled urls (__last_1, __last_2, label, fold): blocked and all, by fold."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col(f"__last_{i}").alias("suffix")) for i in (1, 2)))).alias("s")
    of = lambda value: F.array(*(F.sum(F.when(F.col("fold") == f, value).otherwise(0.0)) for f in range(FOLDS)))
    return known.select("label", "fold", parts).groupBy("s.part", "s.suffix").agg(of(F.col("label")).alias("sums"), of(F.lit(1.0)).alias("counts"))


def with_rates(df: DataFrame, stats: DataFrame, prior: float, broadcast: bool, fold: str | None = None) -> DataFrame:
    """df with the blocked share of its host's last labels (of other folds than its own, if named), the prior where there is none."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x) - (F.element_at(values, F.col(fold) + 1) if fold else 0.0)
    for i in (1, 2):
        own = stats.where(F.col("part") == i).select(F.col("suffix").alias(f"__last_{i}"), F.col("sums").alias("__sums"), F.col("counts").alias("__counts"))
        df = df.join(F.broadcast(own) if broadcast else own, f"__last_{i}", "left")
        rate = (total(F.col("__sums")) + PRIOR_WEIGHT * prior) / (total(F.col("__counts")) + PRIOR_WEIGHT)
        df = df.withColumn(f"__rate_{i}", F.coalesce(rate, F.lit(prior))).drop("__sums", "__counts")
    return df


def binning(rated: DataFrame, n: int) -> Bucketizer:
    """Bins __bin_<feature> of about as many of the n rows each, by counts of all values; a value is in one bin only."""
    bins = max(2, min(BINS, n // BIN_URLS))
    value = lambda f: F.floor(F.col(f"__{f}") * 1000) / 1000 if f in RATIOS else F.col(f"__{f}")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), value(f).alias("x")) for i, f in enumerate(FEATURES)))).alias("v")
    counts = rated.select(each).groupBy("v.i", "v.x").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counts.withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) * bins / n))
    least = [[] for _ in FEATURES]
    for i, x in numbered.groupBy("i", "bin").agg(F.min("x").alias("x")).orderBy("i", "x").select("i", "x").collect():
        least[i].append(x)
    # The first bin is open below; a feature of one value keeps that as its limit, as there must be one.
    limits = [[float("-inf"), *(x[1:] or x), float("inf")] for x in least]
    return Bucketizer(splitsArray=limits, inputCols=[f"__{f}" for f in FEATURES], outputCols=[f"__bin_{f}" for f in FEATURES])


def with_features(rated: DataFrame, bins: Bucketizer) -> DataFrame:
    return VectorAssembler(inputCols=[f"__bin_{f}" for f in FEATURES], outputCol="__features").transform(bins.transform(rated))


@dataclass
class Judge:
    """Trees, the bins and suffix statistics they read, the limit of `block`, and how trees do on the folds they learnt without."""

    trees: GBTClassificationModel
    bins: Bucketizer
    stats: DataFrame
    prior: float
    limit: float
    auc: float
    blocked_of_block: float
    blocked_of_allow: float

    def score(self, df: DataFrame, fold: str | None = None) -> DataFrame:
        """df (with lexical features) with block_score."""
        rated = with_rates(df, self.stats, self.prior, small(self.stats, BROADCAST_SUFFIXES), fold)
        return self.trees.transform(with_features(rated, self.bins)).withColumn("block_score", F.element_at(vector_to_array("__prob"), 2))


def held_out_figures(counts: list[tuple[float, float, float]]) -> tuple[float, float, float, float]:
    """(limit, area under the curve, share of block that is blocked, share of allow that is) of (score, allowed, blocked), by score."""
    allowed, blocked = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not allowed or not blocked:
        return 0.5, float("nan"), float("nan"), float("nan")
    area, below, passed, best, before = 0.0, 0.0, 0.0, None, None
    for score, own_allowed, own_blocked in counts:
        # A limit halfway to the score before blocks all from here on.
        caught, wrong = 1 - passed / blocked, 1 - below / allowed
        if best is None or caught - wrong > best[0]:
            best = caught - wrong, score if before is None else (before + score) / 2, caught, wrong
        area += own_blocked * (below + own_allowed / 2)
        below, passed, before = below + own_allowed, passed + own_blocked, score
    return best[1], area / (allowed * blocked), best[2], best[3]


def fit(known: DataFrame) -> Judge | str:
    """A judge from labelled urls (url, host, path, label: 1.0 to block), or the only verdict there is."""
    fold = F.pmod(F.xxhash64("url", F.lit(21)), F.lit(FOLDS)).cast("int")
    urls = known.groupBy("url", "host", "path", "label").agg(F.count("*").alias("copies")).withColumn("fold", fold)
    urls = cut(lexical(urls, "url", "host", "path"), "url-labelled")
    sizes = {f: (size, bad) for f, size, bad in urls.groupBy("fold").agg(F.count("*"), F.sum("label")).orderBy("fold").collect()}
    n, blocked = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    if not n or blocked in (0, n):
        return BLOCK if n and blocked else ALLOW
    prior = blocked / n
    stats = cut(suffix_statistics(urls), "url-suffixes")
    weight = F.when(F.col("label") == 1.0, F.lit(0.5 / prior)).otherwise(0.5 / (1 - prior))
    rated = with_rates(urls, stats, prior, small(stats, BROADCAST_SUFFIXES), "fold").withColumn("__weight", weight)
    # As many parts as the rows ask for: each level of the trees is a job of its own.
    parts = rated.repartition(-(-n // PART_URLS), "url", "label")
    rated = cut(parts.select("label", "fold", "__weight", *(f"__{f}" for f in FEATURES)), "url-rated")
    bins = binning(rated, n)
    ready = with_features(rated, bins).select("__features", "label", "__weight", "fold")
    trees = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="__weight", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=3, predictionCol="__p").setRawPredictionCol("__raw").setProbabilityCol("__prob")
    # Each fold is scored by trees from the others, where these have both classes.
    apart = [f for f, (size, bad) in sizes.items() if 0 < blocked - bad < n - size]
    grow = inheritable_thread_target(known.sparkSession)(lambda f: trees.fit(ready if f is None else ready.where(F.col("fold") != f)))
    with ThreadPool(GROWN) as pool:
        model, *others = pool.map(grow, [None, *apart])
    counts = []
    if others:
        scored = [m.transform(ready.where(F.col("fold") == f)).select("label", "__prob") for f, m in zip(apart, others, strict=True)]
        scores = reduce(DataFrame.unionByName, scored).withColumn("score", F.round(F.element_at(vector_to_array("__prob"), 2), 4))
        counts = scores.groupBy("score").agg(F.sum(1 - F.col("label")), F.sum("label")).orderBy("score").collect()
    limit, area, caught, wrong = held_out_figures([tuple(r) for r in counts])
    forget(rated, urls)
    return Judge(model, bins, stats, prior, limit, area, caught, wrong)


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]], url: str) -> DataFrame:
    """(url, host, path, label) of the urls that a rule decides."""
    judged = with_rule(pages, rules, url).where(F.col("__rule").isNotNull())
    return judged.select(quoted(url).alias("url"), "host", "path", (F.col("__rule.verdict") == BLOCK).cast("double").alias("label"))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]], url: str) -> DataFrame:
    parts = df.withColumns({"host": host_of(quoted(url)), "path": path_of(quoted(url))})
    return parts.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and block_score (the trees' probability of block; null for lack of two classes).

    labelled: (url, verdict) to learn from; None: the pages that a rule decides.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "block_score")
    if labelled is None:
        known = labelled_by_rules(pages.select(quoted(url)), rules, url)
    else:
        known = with_rule(labelled.where(F.col("verdict").isin(BLOCK, ALLOW)).select("url", "verdict"), [], "url")
        known = known.select("url", "host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label"))
    found = fit(known)
    out = with_rule(pages, rules, url).withColumn("rule", F.col("__rule.rule"))
    if isinstance(found, str):
        return out.withColumn("verdict", F.coalesce("__rule.verdict", F.lit(found))).withColumn("block_score", F.lit(None).cast("double")).drop("__rule")
    scored = found.score(lexical(out, url, "host", "path"))
    verdict = F.coalesce("__rule.verdict", F.when(F.round("block_score", 4) >= found.limit, BLOCK).otherwise(ALLOW))
    return scored.withColumn("verdict", verdict).select(*map(quoted, pages.columns), "host", "path", "rule", "verdict", "block_score")
