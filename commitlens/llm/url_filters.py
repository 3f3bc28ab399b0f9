"""URL filters: rules by host and path, and for all other URLs a logistic regression on hashed character n-grams.

The n-grams (3 to 5 characters) of the host and of the path, each marked with its part and its ends, are hashed into
2^BITS features. The regression is fitted by Spark's own optimiser on a small labelled URL table; labelled_urls makes one
from a rule: names of junk and of ordinary sites in the layouts that hosts and paths have, each layout in both classes, so
that only names tell them apart. Another table (url, label: 1 block, 0 allow) is a parameter.

Defined results: a null url, or one without ://, has an empty host and path, no n-grams and no rule, and is allowed;
rules compare the lower-cased host; of fitting rules the longest text wins, then the longest host; repeated rows are
judged each; an empty table gives an empty result; other columns are ignored. A URL of any length is read whole.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import lower_ascii

#: Fixed values of the contract: verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules are compared one after the other, so they are few.
MOST_RULES = 1000
BITS, GRAMS = 16, (3, 4, 5)
PENALTY, ROUNDS = 1e-4, 60
#: Rows of the labelled table that is made, and the share of them that is junk.
MADE_ROWS, JUNK_SHARE = 3000, 0.3
JUNK = (
    "casino", "poker", "bets", "betting", "jackpot", "slots", "lotto", "roulette", "win", "winner", "prize", "free", "cheap", "discount", "pills", "pharma", "meds", "viagra", "diet",
    "adult", "porn", "xxx", "sex", "escort", "cams", "hookup", "spam", "scam", "farm", "ads", "adserver", "banner", "track", "tracker", "clicks", "popup", "replica", "loans", "payday", "warez", "crack", "keygen",
)
ORDINARY = (
    "news", "science", "library", "museum", "garden", "music", "history", "recipes", "weather", "travel", "school", "university", "forum", "docs", "health", "city", "council", "journal", "archive", "sports",
    "art", "books", "film", "nature", "physics", "math", "language", "kitchen", "craft", "radio", "theatre", "church", "village", "trains", "cycling", "climbing", "chess", "software", "python", "law", "press", "times",
)
SYLLABLES = ("an", "be", "cor", "da", "el", "fi", "gan", "hel", "in", "jo", "ka", "lo", "men", "nor", "ou", "pel", "ra", "sha", "the", "ti", "tion", "ul", "ver", "wha", "yo", "zen", "th", "st", "re", "ble")


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def labelled_urls(spark: SparkSession, rows: int = MADE_ROWS, seed: int = 12) -> DataFrame:
    """url, label of so many made URLs; the same for the same seed."""
    r = random.Random(seed)
    made = []
    for _ in range(rows):
        label = int(r.random() < JUNK_SHARE)
        words = JUNK if label else ORDINARY
        name = r.choice([r.choice(words), f"{r.choice(words)}-{r.choice(words)}", r.choice(words) + r.choice(words), f"{r.choice(words)}-x", r.choice(words) + str(r.randint(1, 99))])
        if not label and r.random() < 0.6:  # a name that is no word
            name = "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))
        host = r.choice(["", "", "www.", "blog.", "m.", "shop."]) + name + r.choice(["", ".example"]) + r.choice([".com", ".net", ".org", ".info", ".de"])
        path = r.choice(["", "/", f"/{r.choice(['en', 'de', 'fr', 'es', 'a', 'post', 'item'])}/{r.randint(1, 99999)}", f"/{r.randint(1990, 2030)}/{r.randint(1, 12)}/{r.choice(SYLLABLES)}{r.choice(SYLLABLES)}"])
        if r.random() < 0.3:
            path += f"/{r.choice(words)}-{r.choice(words)}"
        made.append((f"{r.choice(['http', 'https'])}://{host}{path}{r.choice(['', '.html', '/'])}{r.choice(['', '?page=2', '#top'])}", label))
    return spark.createDataFrame(made, "url string, label int").coalesce(1)


def _grams(text: Column, mark: str) -> Column:
    """The n-grams of a part between its ends, each with the part's mark; none of an empty part. One pass for each length."""
    whole = F.when(F.length(text) > 0, F.concat(F.lit("\x02"), text, F.lit("\x03"))).otherwise("")
    each = [F.transform(F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g)) for n in GRAMS]
    return F.concat(*each)


def _features(df: DataFrame) -> DataFrame:
    """df (host, path, ...) with a sparse vector of its hashed n-grams."""
    grams = df.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << BITS, binary=True).transform(grams).drop("grams")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fits on a small table (url, label: 1 block, 0 allow)."""
    parts = labelled.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, standardization=False).fit(_features(parts))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    each = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("h"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    best = F.array_max(F.array_compact(F.array(*each)))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's, 0 to 1, higher: block) for every row of pages (page_id, url)."""
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    scored = model.setProbabilityCol("probability").transform(_features(parts))
    nothing = (F.col("host") == "") & (F.col("path") == "")
    score = F.when(nothing, 0.0).otherwise(vector_to_array("probability")[1])
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("score", score).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
