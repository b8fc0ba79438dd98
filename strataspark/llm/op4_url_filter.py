"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

URLs that a rule judges are the labelled ones. Trees are fitted on at most MAX_LABELLED different ones (half for each verdict, those with
the smallest hashes, weighted back to the verdicts' shares) and give the other URLs a probability of being blocked. Features are numbers of the
URL's characters, and how often other labelled URLs whose hosts have the same endings, or whose paths have the same
first segment, were blocked: in training only those of other folds count, so a URL's own label never does. The endings' table comes from the bounded sample, so it may be broadcast.
All of it is DataFrame expressions and the library's own tree learner, without Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read

MAX_LABELLED, TREES, DEPTH, SEED, SMOOTH, FOLDS = 20_000, 10, 3, 7, 4.0, 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
ENDINGS = ("_tld", "_domain", "_segment")
FEATURES = ("url_length", "host_length", "host_labels", "path_depth", "path_length", "digit_ratio", "entropy", "parameters", "hyphens", "https", "tld_rate", "domain_rate", "segment_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #. Both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def judged(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _count(c: Column, sign: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))).cast("double")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters in bits; all beyond ASCII count as one."""
    n = F.length(c).cast("double")
    ascii_ = [F.array(*[F.lit(chr(k)) for k in range(128)])]
    counts = F.transform(ascii_[0], lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))).cast("double"))
    rest = n - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(F.concat(counts, F.array(rest)), F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds features of _url, _host and _path, and the keys of the endings."""
    u, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    labels = F.split(host, r"\.")
    n = F.length(u).cast("double")
    return pages.withColumns({
        "url_length": n, "host_length": F.length(host).cast("double"), "host_labels": F.size(labels).cast("double"), "path_depth": _count(path, "/"), "path_length": F.length(path).cast("double"),
        "digit_ratio": F.when(n > 0, F.length(F.translate(u, "0123456789", "")) / n * -1 + 1).otherwise(0.0), "entropy": entropy(u), "parameters": _count(u, "="), "hyphens": _count(u, "-"), "https": u.startswith("https:").cast("double"),
        "_tld": F.element_at(labels, -1), "_domain": F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2)), "_segment": F.regexp_extract(path, "^/([^/]*)", 1),
    })


def _keyed(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds _url, _host, _path, _rule and _verdict of url."""
    host, path = host_and_path(pages["url"].cast("string"))
    text, verdict = judged(F.col("_host"), F.col("_path"), rules)
    return pages.select("*", F.coalesce(pages["url"].cast("string"), F.lit("")).alias("_url"), host.alias("_host"), path.alias("_path")).withColumns({"_rule": text, "_verdict": verdict})


class UrlModel:
    """Boosted trees on lexical features, fitted on (_url, _host, _path, label) with different _url; only is the one known label, if there is just one, or allow's."""

    def __init__(self, labelled: DataFrame, max_labelled: int = MAX_LABELLED):
        labelled = cut(labelled)
        n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
        self.only = None if len(n) == 2 else max(n, default=0.0)
        if self.only is not None:
            return
        half = max_labelled // 2
        some = [labelled.where(F.col("label") == y).orderBy(F.xxhash64("_url"), "_url").limit(half).withColumn("weight", F.lit(max(1.0, n[y] / half))) for y in (0.0, 1.0)]
        fold = F.pmod(F.xxhash64(F.lit(SEED), "_url"), F.lit(FOLDS))
        train = lexical(some[0].union(some[1])).withColumn("fold", fold.cast("int")).persist()
        self.share = n[1.0] / (n[0.0] + n[1.0])
        sums = [F.array(*[F.sum(F.when(F.col("fold") == k, x).otherwise(0.0)) for k in range(FOLDS)]) for x in (F.col("label") * F.col("weight"), F.col("weight"))]
        self.tables = [(e, cut(train.groupBy(e).agg(sums[0].alias(f"{e}_s"), sums[1].alias(f"{e}_n")))) for e in ENDINGS]  # at most max_labelled endings
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        learner = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        self.model = learner.fit(self.assembler.transform(self.rated(train, F.col("fold"))))
        train.unpersist()

    def rated(self, df: DataFrame, fold: Column) -> DataFrame:
        """Adds the endings' rates, counted without a row's fold; -1 is none."""
        for e, table in self.tables:
            total = lambda x: F.coalesce(F.aggregate(F.transform(x, lambda v, k: F.when(k == fold, 0.0).otherwise(v)), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
            rate = (total(F.col(f"{e}_s")) + SMOOTH * self.share) / (total(F.col(f"{e}_n")) + SMOOTH)
            df = df.join(F.broadcast(table), e, "left").withColumn(f"{e[1:]}_rate", rate).drop(f"{e}_s", f"{e}_n")
        return df

    def blocked(self, df: DataFrame) -> DataFrame:
        """Adds blocked, the probability, to a table with _url, _host and _path."""
        if self.only is not None:
            return df.withColumn("blocked", F.lit(float(self.only)))
        told = self.model.transform(self.assembler.transform(self.rated(lexical(df), F.lit(-1))))
        return told.withColumn("blocked", vector_to_array("probability")[1])


def labelled_urls(base: DataFrame) -> DataFrame:
    """The different URLs that a rule judges, with label 1 for block."""
    return base.where("_verdict IS NOT NULL").select("_url", "_host", "_path", (F.col("_verdict") == "block").cast("double").alias("label")).dropDuplicates(["_url"])


def held_out_report(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(urls, blocked, right, caught): labelled URLs whose crc32 mod 3 is 1, judged by trees fitted on the others; the share judged rightly, and of the blocked ones."""
    labelled = labelled_urls(_keyed(pages.select("url"), rules))
    out = F.crc32("_url") % 3 == 1
    told = UrlModel(labelled.where(~out), max_labelled).blocked(labelled.where(out)).select("label", (F.col("blocked") >= 0.5).cast("double").alias("said"))
    return told.agg(F.count("*").alias("urls"), F.sum("label").cast("long").alias("blocked"), F.avg((F.col("said") == F.col("label")).cast("double")).alias("right"), F.avg(F.when(F.col("label") == 1, F.col("said"))).alias("caught"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """pages with host, path, rule, verdict and blocked, the trees' probability (null where a rule fits).

    Null URLs are empty ones: host and path are empty, and the trees judge them. Without labelled URLs of both kinds
    every URL that no rule fits gets the one known verdict, or allow. Rows are judged one by one, so repeated ones are
    alike; very long URLs are judged whole. Columns of the added names are replaced. An empty table gives an empty table."""
    own = ("host", "path", "rule", "verdict", "blocked")
    named = [c for c in pages.columns if c not in own]
    row = F.struct(*(pages[c] for c in named)) if named else F.lit(None)
    base = _keyed(pages.select(row.alias("_row"), pages["url"].cast("string").alias("url")), rules)
    model = UrlModel(labelled_urls(base), max_labelled)
    told = model.blocked(base.drop("url"))
    kept = [F.col("_row")[c].alias(c) for c in named]  # carried whole, so that no name clashes with the features
    verdict = F.coalesce("_verdict", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return told.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_verdict").isNull(), F.col("blocked")).alias("blocked"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "blocked")
