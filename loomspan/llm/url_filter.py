"""URL filters by gradient-boosted trees on lexical features (operator 10). DataFrame functions only.

Rules decide the URLs that they fit. A boosted ensemble of trees, trained on labelled URLs (here: those that a
rule decides), judges the others. The features are lexical: lengths, depth, digit ratio, entropy, parameters,
and the share of blocked URLs among labelled ones with the same host suffix. The trained trees are written out
as nested CASE expressions, so scoring is one projection inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, hash_fraction

#: Bounded labelled sample that the trees are fitted on; rows at the overall share that are added to each host suffix's.
TRAIN_ROWS, SUFFIX_PRIOR_ROWS = 20_000, 5
TREES, DEPTH, STEP = 20, 4, 0.2
#: Part of the training URLs whose host counts as unknown, so that the trees also learn to judge hosts without labels.
UNKNOWN_HOSTS = 0.3

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host + path; null if none) and its verdict. Of equal length the first in ``rules`` wins.

    A rule fits its host and all subdomains where the path starts with the rule's. ``rules`` are few: they become expressions.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _count(x: Column, chars: str) -> Column:
    """How many characters of ``x`` are in ``chars``."""
    return F.length(x) - F.length(F.translate(x, chars, ""))


def lexical(url: str = "url", host: str = "host", path: str = "path") -> dict[str, Column]:
    """Numeric features of a URL from its text alone; null URLs count as empty."""
    u, h, p = F.lower(F.coalesce(F.col(url), F.lit(""))), F.col(host), F.col(path)
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_sort(F.array_distinct(F.regexp_extract_all(u, F.lit("(?s)."), F.lit(0))))  # sorted: equal sums for equal counts
    shares = F.transform(chars, lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, s: a - s * F.log2(s))
    letters = F.greatest(F.length(h), F.lit(1)).cast("double")
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"),
        "depth": F.size(F.filter(F.split(p, "/", -1), lambda x: x != "")).cast("double"),
        "labels": F.size(F.split(h, r"\.", -1)).cast("double"),
        "digit_ratio": _count(u, "0123456789") / n,
        "host_digit_ratio": _count(h, "0123456789") / letters,
        "hyphens": _count(h, "-").cast("double"),
        "entropy": entropy,
        "parameters": (_count(u, "&") + F.when(u.contains("?"), 1).otherwise(0)).cast("double"),
        "fragment": F.when(u.contains("#"), 1.0).otherwise(0.0),
        "secure": F.when(u.startswith("https://"), 1.0).otherwise(0.0),
        "vowel_ratio": _count(h, "aeiou") / letters,
    }


def suffixes(host: Column) -> tuple[Column, Column]:
    """The last label and the last two labels of a host."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


@dataclass
class UrlModel:
    """Trees as SQL, the table (suffix, share) of all labelled host suffixes and the share of blocked rows overall."""

    margin: str
    shares: DataFrame
    base: float
    names: list[str]

    def score(self) -> Column:
        """Probability of "block" from the columns of ``features``."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.expr(self.margin)))


def _tree_sql(node, names: list[str]) -> str:
    """A fitted tree as nested CASE expressions."""
    if node.numDescendants() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    name = names[split.featureIndex()]
    return f"CASE WHEN `f_{name}` <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def features(df: DataFrame, shares: DataFrame, base: float) -> DataFrame:
    """``df`` (url, host, path) with one column f_<name> for each feature; suffixes that ``shares`` lacks have the share ``base``."""
    for name, suffix in zip(("tld_share", "suffix_share"), suffixes(F.col("host"))):
        df = df.join(shares.select(F.col("suffix").alias("suffix_"), F.col("share").alias(f"f_{name}")), suffix == F.col("suffix_"), "left").drop("suffix_")
        df = df.withColumn(f"f_{name}", F.coalesce(f"f_{name}", F.lit(base)))
    return df.withColumns({f"f_{k}": v for k, v in lexical().items()})


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel | None:
    """Fit the trees on a bounded sample of ``labelled`` (url, host, path, blocked 0/1); None without both labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r["blocked"]: r["count"] for r in labelled.groupBy("blocked").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    keep = F.coalesce(*[F.when(F.col("blocked") == k, F.lit(min(1.0, rows / 2 / n))) for k, n in counts.items()])
    sample = labelled.where(hash_fraction("url") < keep).select("url", "host", "path", "blocked")
    base = counts[1] / (counts[0] + counts[1])
    one, two = suffixes(F.col("host"))
    seen = labelled.select(F.explode(F.array_distinct(F.array(one, two))).alias("suffix"), "blocked").groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("n"))
    share = (F.col("blocked") + SUFFIX_PRIOR_ROWS * base) / (F.col("n") + SUFFIX_PRIOR_ROWS)
    shares = Scratch(labelled.sparkSession).cut(seen.select("suffix", share.alias("share")), "suffixes")
    x = features(sample, shares, base)
    unknown = hash_fraction(F.col("url"), F.lit("unknown")) < UNKNOWN_HOSTS
    x = x.withColumns({c: F.when(unknown, F.lit(base)).otherwise(F.col(c)) for c in ("f_tld_share", "f_suffix_share")})
    names = [c[2:] for c in x.columns if c.startswith("f_")]
    ready = VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features").transform(x).select("features", F.col("blocked").cast("double").alias("label")).coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, seed=7, maxBins=32).fit(ready)
    java = model._java_obj
    margin = " + ".join(f"{float(w)!r}D * ({_tree_sql(t.rootNode(), names)})" for t, w in zip(java.trees(), java.treeWeights()))
    return UrlModel(margin, shares, base, names)


def filter_urls(pages: DataFrame, rules: list[Rule], cutoff: float = 0.5) -> DataFrame:
    """``pages`` (url) with host, path, rule, verdict ("allow" or "block") and block_score added.

    Rules decide where one fits: rule is its host and path, else null. The trees, trained on the URLs that rules
    decide, judge the others: "block" from ``cutoff`` on. block_score is the trees' probability, also where a rule decides.

    Null URLs and those without "://" have an empty host and path, fit no rule and are judged by the trees like
    others. Without labelled URLs of both kinds there are no trees: score 0, "allow". Equal URLs get equal results.
    Of rules of equal length that fit, the first counts. URLs of any length are read whole.
    Repeated rows stay. Columns with these names in ``pages`` are replaced, all others kept. An empty table gives
    an empty table.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "block_score")
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), "url")
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = urls.withColumns({"rule": rule, "decided": verdict})
    labelled = ruled.where("rule is not null").select("url", "host", "path", F.when(F.col("decided") == "block", 1).otherwise(0).alias("blocked"))
    model = train(labelled)
    if model is None:
        scored = ruled.withColumn("block_score", F.lit(0.0))
    else:
        scored = features(ruled, model.shares, model.base).withColumn("block_score", model.score())
    judged = F.coalesce("decided", F.when(F.col("block_score") >= cutoff, "block").otherwise("allow"))
    return scored.select(*[F.col(f"page.`{c}`") for c in pages.columns], "host", "path", "rule", judged.alias("verdict"), "block_score")
