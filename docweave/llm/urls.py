"""URL filters: longest matching rule, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.expr import let

FEATURES = 1 << 14
SIZES = (3, 4, 5)
# Labelled URLs to train on (fixed values): True for addresses that a corpus should not hold.
LABELLED = (
    ("http://spam-farm.example/win", True), ("http://www.spam-links.example/en/1", True), ("https://casino-bonus.example/play", True),
    ("http://free-casino.example/slots?ref=1", True), ("https://cheap-pills.example/buy", True), ("http://pills-online.example/order", True),
    ("https://adult-xxx.example/video", True), ("http://xxx-tube.example/watch/12", True), ("http://poker-win.example/bet", True),
    ("https://bet-jackpot.example/en/7", True), ("http://payday-loans.example/apply", True), ("https://loan-fast.example/cash", True),
    ("http://link-farm.example/out/55", True), ("https://seo-farm.example/backlinks", True), ("http://malware-drop.example/setup.exe", True),
    ("https://warez-crack.example/keygen", True), ("http://torrent-spam.example/get", True), ("https://click-bait.example/ad/track", True),
    ("http://ads.tracker.example/click?id=9", True), ("https://spamblog.example/fr/3", True), ("http://spam.example/de/8.html", True),
    ("https://farm-spam.example/es/2", True), ("http://replica-watches.example/shop", True), ("https://escort-spam.example/en/4", True),
    ("https://news.example/en/politics", False), ("http://blog.garden.example/en/12", False), ("https://www.library.example/fr/livres", False),
    ("http://docs.project.example/de/handbuch.html", False), ("https://museum.example/es/arte", False), ("http://m.weather.example/en/5", False),
    ("https://university.example/courses/3", False), ("http://recipes.example/fr/44", False), ("https://history.example/de/9", False),
    ("http://blog.travel.example/es/7.html", False), ("https://science.example/en/articles/61", False), ("http://www.school.example/en/8", False),
    ("https://city.example/news?page=2", False), ("http://the-river.example/en/100", False), ("https://health.example/en/advice", False),
    ("http://forum.music.example/thread/81", False), ("https://wiki.example/en/page", False), ("http://station.example/fr/533", False),
    ("https://m.therapy.example/en/25#top", False), ("http://notion.example/en/685", False), ("https://ratings.example/en/770", False),
    ("https://thread.example/fr/825?page=2", False), ("http://nation.example/en/369#top", False), ("https://table.example/es/2?utm_source=feed", False),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(rule: tuple[str, str, str]) -> str:
    return f"{rule[1]}{rule[2]}"


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path start) that fits, as struct(rule, verdict); null if none does.

    A rule fits its host and all subdomains. Length is that of host and path start together; of
    equally long ones the first holds.
    """
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(rule_name((v, h, p))).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams of a text between bounds, each with the mark of the part it comes from."""
    bounded = F.concat(F.lit("^"), text, F.lit("$"))
    each = lambda t, n: F.when(
        F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.concat(F.lit(mark), F.substring(t, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))
    return let(bounded, lambda t: reduce(F.concat, [each(t, n) for n in SIZES]))


def features(urls: DataFrame) -> DataFrame:
    """Add ``features``: hashed n-grams of the columns host and path. Digits are one class of characters."""
    plain = [F.regexp_replace(c, r"[0-9]+", "0") for c in ("host", "path")]
    grams = urls.withColumn("_grams", F.concat(_grams(plain[0], "h"), _grams(plain[1], "p")))
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(grams).drop("_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small table of labelled URLs: url, unwanted."""
    return spark.createDataFrame([(u, float(bad)) for u, bad in LABELLED], "url string, unwanted double")


def train(labelled: DataFrame, strength: float = 0.01, most: int = 20_000) -> LogisticRegressionModel:
    """Fit on a small table (url, unwanted 0 or 1).

    At most ``most`` rows are read, those of the smallest hashes of their urls, in one partition and
    a fixed order, so that a fit can be repeated exactly. Rows with nulls are left out.
    """
    sample = labelled.where("url is not null and unwanted is not null").orderBy(F.xxhash64("url"), "url", "unwanted").limit(most).coalesce(1)
    parts = sample.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("unwanted").cast("double").alias("label"))
    return LogisticRegression(regParam=strength, maxIter=60, standardization=False).fit(features(parts))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and ``unwanted`` (probability) of every row of ``pages(page_id, url)``.

    The longest rule decides; without one a probability above ``cut`` blocks. Null urls and urls
    without ``://`` have an empty host and path and are judged like any other. No shuffle.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(features(parts)).withColumn("unwanted", F.get(vector_to_array("probability"), F.lit(1)))
    ruled = scored.withColumn("_hit", matching_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("unwanted") > cut, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", learned).alias("verdict"), "unwanted")
