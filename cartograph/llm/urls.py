"""URL filter: host and path rules, then a classifier of the address itself.

A rule names a host, with its subdomains, and the start of a path; of the rules
that fit an address the longest decides. Addresses that no rule fits are judged
by logistic regression on hashed character n-grams of host and path, trained
from a small labelled table of addresses. A part of the table is held out from
a first fit to set the score from which an address is blocked: that which
``HARMLESS`` of the held-out harmless addresses stay under, 0.5 at least. The
model that judges is then fitted on the whole table.

Only DataFrame functions and ``pyspark.ml`` stages on them are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions.text import STOP_WORDS

#: (rule, verdict): fixed values of the task.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block")]

#: Labelled addresses the classifier is trained from: names and paths as they
#: are common for spam, gambling, adult, tracking and pirate sites, and for
#: ordinary ones.
BLOCK_WORDS = ["casino", "poker-online", "slots-bonus", "sportsbet", "betting-tips", "jackpot", "lottery-win", "roulette",
               "cheap-meds", "pills-online", "viagra-shop", "pharmacy-discount", "weight-loss-pills", "adult-video",
               "porn-tube", "xxx-cams", "sexchat", "escort-dates", "hookup", "spam-mail", "spamlinks", "linkfarm",
               "link-farm", "ads-server", "adtracker", "click-track", "popunder-ads", "free-iphone", "win-prize",
               "free-money", "payday-loan", "crypto-doubler", "warez", "crackz", "torrent-keygen", "free-download-crack",
               "replica-watches", "seo-backlinks", "clickbait", "malware-load", "pills-store", "buy-pills",
               "my-pills", "online-casino", "free-slots", "bets-online", "sex-videos", "adult-chat", "ad-network",
               "track-clicks", "spam-blog", "torrent-movies", "fast-loans", "poker-room"]
ALLOW_WORDS = ["library", "museum", "university", "city-council", "weather", "newspaper", "daily-news", "magazine", "science",
               "physics", "biology", "medicine-journal", "history", "archive", "encyclopedia", "dictionary", "recipes",
               "cooking", "garden", "travel", "maps", "hiking", "school", "teachers", "students", "research", "institute",
               "hospital", "charity", "music", "orchestra", "theatre", "literature", "poetry", "painting", "photography",
               "software", "developer-docs", "linux", "python-tutorial", "mathematics", "statistics", "forum", "football-club",
               "chess", "cycling", "railway", "airport", "market", "bookshop", "hotel", "restaurant", "bank", "insurance",
               "law", "parliament", "embassy", "energy", "climate", "astronomy"]
PLACES = ["www.{}.org/en/{}", "blog.{}.net/{}.html", "{}.example.org/de/{}", "m.{}.info/fr/{}"]


def labelled_urls() -> list[tuple[str, int, str]]:
    """``(url, 1 for block, word)``: every word at each of the places, so that the
    places themselves tell nothing."""
    rows = []
    # common words of the language as well, so that their letter runs tell nothing
    common = [w for w in STOP_WORDS if len(w) > 3]
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS + common)):
        for i, w in enumerate(words):
            rows += [("https://" + place.format(w, 100 + 7 * i), label, w) for place in PLACES]
    return rows


#: So many that the n-grams of a few hundred addresses seldom meet.
BUCKETS = 1 << 16
SIZES = (3, 4)
REGULARIZATION = 0.003
#: One in so many words (or hosts) is held out, and the share of its harmless
#: addresses that must not be blocked.
HELD_OUT = 4
HARMLESS = 0.995

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of the host, marked at its ends, and of the path with
    its digits folded; each kind apart."""
    def of(text: Column, mark: str, n: int) -> Column:
        last = F.length(text) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(text, i, n)))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))
    h = F.concat(F.lit("^"), host, F.lit("$"))
    p = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(*[of(h, "h", n) for n in SIZES], *[of(p, "p", n) for n in SIZES])


def hashed(df: DataFrame, host: str, path: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    grams = f"{out}_grams"
    tf = HashingTF(inputCol=grams, outputCol=out, numFeatures=buckets, binary=True)
    return tf.transform(df.withColumn(grams, ngrams(F.col(host), F.col(path))))


@dataclass
class Filter:
    """A fitted classifier: addresses are blocked from a score of ``threshold``.
    ``precision`` and ``recall`` are those of the first fit on the held-out
    addresses (None where it blocked none, or none was to block). Without a
    ``model`` nothing is blocked."""

    model: LogisticRegressionModel | None
    threshold: float = 0.5
    precision: float | None = None
    recall: float | None = None


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", group_col: str | None = None) -> Filter:
    """Filter of ``labelled`` addresses (label 1: block, 0: harmless). A small
    table: a few hundred rows suffice, and one partition holds them. Rows of one
    ``group_col`` (by default the host) are held out together. Rows with another
    label or none are left out. A table without both labels, an empty one for
    example, gives a filter that blocks nothing; one whose held-out rows lack a
    label keeps the threshold of 0.5."""
    host, path = host_and_path(F.col(url_col))
    group = F.col(group_col).cast("string") if group_col else host
    x = labelled.where(F.col(label_col).isin(0, 1)).select(
        host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("label"),
        (F.pmod(F.xxhash64(F.coalesce(group, F.lit(""))), F.lit(HELD_OUT)) == 0).alias("held"))
    x = stored = hashed(x.coalesce(1), "host", "path", "x").select("x", "label", "held").cache()
    try:
        rows = {(r.held, r.label): r["count"] for r in x.groupBy("held", "label").count().collect()}
        kinds, of = set(rows), {k: sum(n for (_, label), n in rows.items() if label == k) for k in (0.0, 1.0)}
        if not all(of.values()):
            return Filter(None)
        # both labels weigh the same, however many rows they have
        x = x.withColumn("weight", F.when(F.col("label") == 1, sum(of.values()) / of[1.0]).otherwise(sum(of.values()) / of[0.0]))
        fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=REGULARIZATION, maxIter=50).fit
        if len(kinds) < 4:
            return Filter(fit(x))
        found = fit(x.where(~F.col("held"))).transform(x.where("held")).withColumn("score", vector_to_array("probability")[1])
        harmless = found.where("label = 0").agg(F.percentile("score", F.lit(HARMLESS)).alias("least")).first()
        threshold = max(0.5, harmless.least)
        hit = F.col("score") >= threshold
        r = found.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("right", hit & (F.col("label") == 1)), ("blocked", hit),
                                                                  ("bad", F.col("label") == 1))]).first()
        return Filter(fit(x), threshold, r.right / r.blocked if r.blocked else None, r.right / r.bad if r.bad else None)
    finally:
        stored.unpersist()


def judge(pages: DataFrame, by: Filter, id_col: str = "page_id", url_col: str = "url",
          rules=RULES) -> DataFrame:
    """One row per page: ``(<id>, host, path, rule, verdict, score)``.

    ``score`` is the model's probability of block, ``verdict`` the rule's
    where one fits, else block from the filter's threshold (without a model:
    score 0 and allow). A null address or one
    without ``://`` has an empty host and path and is judged by the model.
    Null ids and repeated rows are rows like any other; an empty table gives no
    rows. Other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    x = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if by.model is None:
        scored = x.withColumn("score", F.lit(0.0))
    else:
        scored = by.model.transform(hashed(x, "host", "path", "x", by.model.numFeatures)) \
            .withColumn("score", vector_to_array("probability")[1])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= by.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, by_model).alias("verdict"), "score")


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int, word string")
