"""URL verdicts: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.rows import only

NGRAMS = (3, 4)
FEATURES = 1 << 15
REGULARISATION = 0.003
#: Unknown names score near one half; only clear evidence blocks.
THRESHOLD = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled URLs are made of these: every name of a class in every place of PLACES, with every path of its class.
BLOCKED_NAMES = (
    "casino-bonus", "spam-farm", "cheap-pills", "free-pills-online", "poker-win", "sex-cams", "xxx-videos", "porn-tube",
    "replica-watches", "payday-loans", "link-farm", "viagra-shop", "crack-warez", "free-bets", "adult-dating", "click-bait",
    "malware-host", "phishing-login",
)
ALLOWED_NAMES = (
    "city-library", "daily-news", "university", "open-science", "garden-journal", "cooking", "history-museum", "code-forum",
    "weather", "travel-stories", "music-review", "law-archive", "health-info", "math-notes", "council", "book-club",
    "river-walks", "school-board",
)
PLACES = ("{}.com", "www.{}.org", "blog.{}.net", "m.{}.example.com", "{}.example.org", "www.{}.example.net")
PATHS = ("", "/", "/en/12", "/fr/7.html", "/2021/05/story.html")
BLOCKED_PATHS = ("/buy-cheap-pills", "/casino/bonus", "/free-download-crack", "/adult/xxx", "/win-money-now")
ALLOWED_PATHS = ("/about", "/docs/index.html", "/topics/history", "/article/review", "/contact")


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, under paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table, ``(url, label)``; 1: block."""
    classes = ((BLOCKED_NAMES, PATHS + BLOCKED_PATHS, 1.0), (ALLOWED_NAMES, PATHS + ALLOWED_PATHS, 0.0))
    rows = [
        (f"http://{place.format(name)}{path}", label)
        for names, paths, label in classes for name in names for place in PLACES for path in paths
    ]
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path: on to ``?`` or ``#``.

    Both are empty for null and where no ``://`` is found.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule], of: str = "text") -> Column:
    """The longest fitting rule's ``of``, or null. The list of rules is a setting, and part of the plan."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(getattr(rule, of))).otherwise(chosen)
    return chosen


def _ngrams(text: Column, mark: str) -> Column:
    """Character n-grams, marked by where they are from; the text is closed by ``^`` and ``$``."""
    closed = F.concat(F.lit("^"), text, F.lit("$"))
    grams = []
    for n in NGRAMS:
        starts = F.when(F.length(closed) >= n, F.sequence(F.lit(1), F.length(closed) - n + 1)).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(starts, lambda i, n=n: F.concat(F.lit(mark), F.substr(closed, i, F.lit(n)))))
    return F.concat(*grams)


def with_features(df: DataFrame, host: Column, path: Column) -> DataFrame:
    terms = df.withColumn("_terms", F.concat(_ngrams(host, "h:"), _ngrams(path, "p:")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_terms", outputCol="_features").transform(terms).drop("_terms")


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit on ``(url, label)``; the table is small, so one partition keeps the sums in one order."""
    rows = with_features(labelled.coalesce(1), *host_and_path(F.col("url")))
    return LogisticRegression(
        featuresCol="_features", labelCol="label", regParam=REGULARISATION, maxIter=50, probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction",
    ).fit(rows)


def judge(
    pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[Rule] = (), id_column: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``score`` (probability of block) and ``verdict``.

    The longest fitting rule decides; where none fits, the score does, against THRESHOLD. Null and broken
    urls have empty host and path and are scored as such. Repeated rows are judged alike. No row moves: there is no
    shuffle, and the model is one vector of FEATURES weights.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = only(pages, id_column, url).select(F.col(f"`{id_column}`").alias("id"), host.alias("host"), path.alias("path"))
    scored = model.transform(with_features(rows, F.col("host"), F.col("path")))
    score = vector_to_array("_probability")[1]
    by_rule = fitting_rule(F.col("host"), F.col("path"), rules, "verdict")
    by_model = F.when(score >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("id").alias(id_column), "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(by_rule, by_model).alias("verdict"), score.alias("score"),
    )
