"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model decides the urls that no rule decides. It learns from a small labelled table, by default the one of ``labelled_urls``
(made from word lists and forms: advertising and junk hosts against ordinary ones), and blocks from the threshold on at which a
held-out fifth of the table (by hash) reaches the wanted precision.

Defined results: a null url, or one without ``://``, has an empty host and path. No labelled row at all: everything the
rules leave open is allowed; labelled rows of one class only: that class. Repeated urls get the same verdict; equal scores too.
Very long urls are cut into n-grams whole, in linear time. An empty table gives an empty result. Only ``key`` and ``url`` are
read, so further columns cannot clash.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.session import pin

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Verdict, host, path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
NGRAM = 3
BUCKETS = 1 << 13
# at most this many distinct labelled urls are used for fitting (those with the smallest hash of the url), weighted by count
LABELLED_ROWS = 20_000
PRECISION = 0.95
TABLE_URLS = 800  # of each class in the default table
# rules are written out as one expression; a longer list belongs in a table
MAX_RULES = 500


# Words of the default labelled table.
JUNK = ("casino", "poker", "bet", "pills", "viagra", "loan", "credit", "xxx", "porn", "sexy", "cheap", "replica", "winner", "bonus", "slots", "crack", "keygen", "torrent", "click", "adserver", "popup", "diet")
ORDINARY = ("library", "news", "school", "museum", "garden", "history", "science", "travel", "recipe", "music", "weather", "sport", "science", "forum", "city", "health", "law", "paper", "review", "team", "river", "house")
SYLLABLES = ("an", "er", "th", "ti", "on", "re", "st", "en", "ou", "in", "sh", "ly", "he", "es", "le", "ou", "ble", "ing")


def labelled_urls(n: int = TABLE_URLS, seed: int = 3) -> list[tuple[str, int]]:
    """(url, label) with ``n`` distinct urls of each class, label 1 for junk; the same for the same seed."""
    rng = random.Random(seed)
    pick = lambda words: rng.choice(words)
    name = lambda: "".join(pick(SYLLABLES) for _ in range(rng.randint(2, 4)))
    end = lambda: pick((".com", ".org", ".net", ".de", ".info", ".example.com", ".example.net", ".example.org"))
    number = lambda: str(rng.randrange(10 ** rng.randint(2, 6)))
    kinds = (
        [lambda: f"{pick(('', 'www.', 'm.', 'blog.'))}{name()}{end()}/{pick(('en', 'de', 'fr', 'es'))}/{number()}{pick(('', '/', '.html'))}", lambda: f"{pick(('', 'www.'))}{pick(ORDINARY)}{end()}/{pick(ORDINARY)}/{number()}",
         lambda: f"{pick(ORDINARY)}-{name()}{end()}/{pick(('about', 'articles', 'archive'))}/{name()}", lambda: f"{name()}{end()}/{name()}/{pick(ORDINARY)}.html"],
        [lambda: f"{pick(JUNK)}-{pick(JUNK)}-{number()}{end()}/{pick(JUNK)}/{number()}", lambda: f"{pick(('www.', ''))}{pick(JUNK)}{number()}{end()}/{pick(('en', 'win', 'go', 'free'))}/{number()}",
         lambda: f"{name()}{end()}/{pick(JUNK)}/{pick(JUNK)}-{pick(('free', 'online', 'now'))}", lambda: f"free-{pick(JUNK)}-{name()}{end()}/{pick(JUNK)}.html"],
    )
    out = []
    for label, forms in enumerate(kinds):
        made: dict[str, None] = {}
        while len(made) < n:
            made.setdefault(f"{pick(('http', 'https'))}://{pick(forms)()}")
        out += [(u, label) for u in made]
    return out


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be written as an expression")
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams_sql(col: str, tag: str, n: int = NGRAM) -> str:
    """Character n-grams with boundary marks; linear in the length of the string."""
    chars = f"split(concat('^', {col}, '$'), '')"
    joined = ", ".join(f"get(c, i + {k})" for k in range(n))
    return (
        f"flatten(transform(array({chars}), c -> transform(sequence(0, greatest(size(c) - {n}, 0)), "
        f"i -> concat_ws('', '{tag}', {joined}))))"
    )


def fit_url_model(labelled: DataFrame, host: str = "host", path: str = "path", label: str = "label", rows: int = LABELLED_ROWS, precision: float = PRECISION):
    """(model, threshold) from at most ``rows`` distinct labelled rows, weighted by count; a fifth of them, by hash, only sets the threshold.

    None without labelled rows, a number where all labels agree.
    """
    kept = (
        labelled.where(F.col(label).isNotNull())
        .select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(label).cast("double").alias("label"))
        # copies are counted first: side by side by hash, those of one url could fill the sample
        .groupBy("host", "path", "label").agg(F.count("*").cast("double").alias("weight"))
        .withColumn("h", F.xxhash64("host", "path")).orderBy("h", "host", "path", "label")
        .limit(rows)
    )
    kept = pin(kept, "labelled-urls")  # read by every step of the fit
    low, high = kept.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return low
    grams = SQLTransformer(statement=f"SELECT *, concat({ngrams_sql('host', 'h')}, {ngrams_sql('path', 'p')}) AS __grams FROM __THIS__")
    hashed = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BUCKETS, binary=True)
    logistic = LogisticRegression(
        featuresCol="__features", labelCol="label", weightCol="weight", predictionCol="__prediction", rawPredictionCol="__raw",
        probabilityCol="__probability", maxIter=40, regParam=1e-3, standardization=False,
    )
    learned = kept.where("pmod(h, 5) <> 0")
    if learned.select("label").distinct().count() < 2:
        learned = kept
    model = Pipeline(stages=[grams, hashed, logistic]).fit(learned)
    steps = [k / 20 for k in range(10, 20)]
    held = model.transform(kept.where("pmod(h, 5) = 0")).select(vector_to_array("__probability")[1].alias("p"), "label", "weight")
    right = held.agg(*[F.expr(f"sum(label * weight) FILTER (WHERE p >= {t}) / sum(weight) FILTER (WHERE p >= {t})").alias(f"t{k}") for k, t in enumerate(steps)]).first()
    return model, next((t for k, t in enumerate(steps) if right[k] is not None and right[k] >= precision), 0.5)


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, score): ``score`` is the model's probability of ``block``.

    ``labelled`` has (url, label), label 1 for block; by default the table of ``labelled_urls``.
    """
    split = pages.select(F.col(key).alias(key), F.col(url).alias("__url")).select(
        key, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path")
    ).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls(), "url string, label int")
    fitted = fit_url_model(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"))
    if isinstance(fitted, tuple):
        model, threshold = fitted
        scored = model.transform(split).withColumn("score", vector_to_array("__probability")[1])
    else:
        threshold = 0.5
        scored = split.withColumn("score", F.lit(fitted or 0.0))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        key, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", learned).alias("verdict"), "score"
    )
