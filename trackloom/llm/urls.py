"""Operator 8: URL filters, in DataFrame functions and pyspark.ml only.

A rule (host, path, verdict) fits its host and all subdomains, if the url's path starts with the rule's path; of the rules that
fit, the longest (host and path together) decides, ties by host, then path. Where none fits, a logistic regression over
hashed character n-grams of host and path decides. It is trained on a small labelled table of urls of at most
``TRAIN_ROWS`` rows (the bound is a parameter); in the query, that table is ``labelled`` below: no labels come with the pages, so the verdicts
there are as good as its words (held-out figures in the README).

Rules are looked up, not scanned: the suffixes of each distinct host (one for each of its labels) are joined to the rules of
that suffix, and the rules found for a host are tested, longest first, on the path of each of its urls.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the model;
repeated rows and ties are judged alike; an empty table gives an empty result. Extra columns pass through ``judge``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stow

TRAIN_ROWS, BUCKETS, SIZES = 20_000, 1 << 16, (3, 4, 5)

#: The rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Words that hosts of either kind are often named by. ``labelled`` makes hosts of them.
BAD = """casino poker slots betting bets jackpot roulette pills pharmacy viagra payday loans credit xxx porn adult cams escort torrent warez crack keygen replica
watches bags cheap free bonus win winner prize gift lottery spam click traffic backlinks followers likes cash earn hack deals coupon miracle diet""".split()
GOOD = """library university school museum gallery archive science physics biology chemistry history weather climate news journal press daily gazette radio city
council region park garden bakery kitchen recipes travel railway airport hotel bike river mountain lake forest health clinic hospital football club choir
theatre cinema books reading poetry language translation dictionary maps atlas code software docs forum wiki data open farm""".split()
#: Paths of spam, and of anything.
BAD_PATHS = "/bonus/claim /win/now.html /free/pills /casino/slots /bet/today /xxx/1".split()
ANY_PATHS = "/en/12 /fr/about /docs/page.html /es/2019/notes/ /article/77 /de/kapitel/3 /index.html /".split()
#: Hosts of each kind, and of hosts with a made-up name that say nothing.
HOSTS = 400
_STARTS, _MIDDLES, _ENDS = "b ch d f g h k l m n p r s st t th tr v w".split(), "a e i o u ai ea ou".split(), " n r s l nd st ng".split(" ")


def made_up(number: int) -> str:
    """A name of two or three syllables, by rule."""
    x, out = number * 2654435761 % 2**32, ""
    for _ in range(2 + number % 2):
        for parts in (_STARTS, _MIDDLES, _ENDS):
            out += parts[x % len(parts)]
            x = x // len(parts) * 2246822519 % 2**32
    return out


def compound(words: list[str], number: int) -> str:
    """A host name of two of the words, joined in one of three ways, or of one and a number."""
    n, turn = len(words), number // len(words)
    a, b = words[number % n], words[(number * 7 + turn * 11 + 3) % n]
    return (f"{a}-{b}", f"{a}{b}", f"{a}{number % 90 + 7}", f"{b}-{a}")[turn % 4]


def names(first: int = 0, hosts: int = HOSTS) -> list[tuple[str, float]]:
    """(name, bad) of ``hosts`` hosts of each kind from number ``first`` on; other numbers give other hosts, for tests."""
    made = [(compound(BAD, k), 1.0) for k in range(first, first + hosts)] + [(compound(GOOD, k), 0.0) for k in range(first, first + hosts)] + [(made_up(k), 0.0) for k in range(first, first + 2 * hosts)]
    return sorted(set(made))


def labelled(spark: SparkSession, hosts: int = HOSTS) -> DataFrame:
    """(url, bad): hosts of either kind, each with some paths, domains and subdomains; a path of spam makes any url bad.

    The names are put together by rule from common words, and made up: none is taken from the pages that are judged.
    """
    domains, fronts = (".example.com", ".example.org", ".example.net", ".test", ".co.uk"), ("", "www.", "m.", "blog.")
    rows = []
    for k, (name, bad) in enumerate(names(0, hosts)):
        for j in range(5):
            spam = j == 4 and k % 4 == 0
            path = BAD_PATHS[k % len(BAD_PATHS)] if spam else ANY_PATHS[(k + 3 * j) % len(ANY_PATHS)]
            rows.append((f"https://{fronts[(k + j) % 4]}{name}{domains[(k // 2 + j) % 5]}{path}", 1.0 if spam else bad))
    return spark.createDataFrame(rows, "url string, bad double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    found = F.instr(url, "://") > 0
    rest = F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    cut = F.instr(rest, "/")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.when(cut > 0, F.substr(rest, F.lit(1), cut - 1)).otherwise(rest), upper, lower)
    return F.when(found, host).otherwise(""), F.when(found & (cut > 0), F.substr(rest, cut)).otherwise("")


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host's labels (without the last two, which name the registry) and of the path."""
    labels = F.split(host, r"\.")
    name = F.concat(F.lit("^"), F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 2)), ".")).otherwise(host), F.lit("$"))

    def of(text: Column, mark: str) -> Column:
        return F.concat(
            *(F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), _gram(text, n, mark))).otherwise(F.array().cast("array<string>")) for n in SIZES)
        )

    return F.concat(of(name, "h"), of(path, "p"))


def _gram(text: Column, n: int, mark: str):
    return lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n)))


def train(table: DataFrame, rows: int = TRAIN_ROWS) -> PipelineModel:
    """Fit on ``table`` (url, bad: 0.0 or 1.0), at most ``rows`` rows of it, the first by hash."""
    bounded = table.where("url is not null and bad is not null").orderBy(F.xxhash64("url"), "url").limit(rows)
    ready = bounded.select(grams(*host_and_path(F.col("url"))).alias("grams"), "bad")
    return Pipeline(stages=[HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="bad", regParam=0.001, maxIter=40, probabilityCol="p", predictionCol="y", rawPredictionCol="z")]).fit(ready)


def judge(df: DataFrame, rules: DataFrame, model: PipelineModel, column: str = "url", at: float = 0.5) -> DataFrame:
    """``df`` with host, path, rule (text or null), score (of the model) and verdict. rules: verdict, host, path."""
    by_host = rules.select(F.col("host").alias("_suffix"), F.struct((-(F.length("host") + F.length("path"))).alias("size"), "host", "path", "verdict").alias("r")).groupBy("_suffix").agg(F.collect_list("r").alias("_rules"))
    host, path = host_and_path(F.col(column))
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "score", "verdict")]
    named = df.select(*keep, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    # rules of all suffixes of the hosts that occur: one row for each distinct host
    hosts = named.select("host").distinct().withColumn("_l", labels)
    suffix = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))).alias("_suffix"))
    fitting = stow(suffix.join(by_host, "_suffix").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("_rules"))).alias("_rules")), "rules")  # written: a host of very many urls can be split in the join
    fit = named.join(fitting, "host", "left").withColumn("_rule", F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    scored = model.transform(fit.withColumn("grams", grams(F.col("host"), F.col("path"))))
    score = vector_to_array("p")[1]
    return scored.select(*keep, "host", "path", F.concat("_rule.host", "_rule.path").alias("rule"), score.alias("score"), F.coalesce("_rule.verdict", F.when(score >= at, "block").otherwise("allow")).alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages.select("page_id", "url"), rules, train(labelled(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
