"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame expressions. The model is trained on a small table of labelled URLs (``examples``): each URL
becomes the set of its hashed 3- and 4-grams, and full-batch gradient descent runs inside one expression over that one
row of arrays. The weights (``BUCKETS`` doubles) reach the pages as a scalar subquery, so scoring a page is one projection:
no join, no shuffle. Only the URL column is read.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and has no n-grams, so the
bias alone decides. Further columns are ignored, repeated rows give repeated results, an empty table an empty result.
A long URL is judged as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, work_folder

# (verdict, host, path prefix): a rule fits its host and all subdomains; the longest rule that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

BUCKETS = 1 << 14
SIZES = (3, 4)
STEPS = 500
RATE = 3.8
BIAS_RATE = 0.3
DECAY = 1e-4
# Probability from which a URL is blocked.
THRESHOLD = 0.6

# The labelled table: hosts of every kind with the paths below.
BAD_NAMES = ("casino-win", "free-casino", "casino-royal", "casinos-online", "free-bets", "bets-now", "sport-bets", "best-bets",
             "ads-track", "track-ads", "ads-click", "click-track", "spam-farm", "spam-links", "link-farm", "content-farm",
             "cheap-pills", "pills-shop", "buy-pills", "cheap-meds", "adult-x", "adult-cams", "x-adult", "adult-videos",
             "poker-win", "porn-tube", "win-prizes", "free-prizes", "payday-loans", "cheap-viagra")
GOOD_NAMES = ("news", "weather", "cooking", "gardens", "library", "science", "museum", "history", "travel", "harbour",
              "teachers", "students", "music", "orchestra", "painting", "physics", "biology", "recipes", "mountain", "river",
              "therapy", "theatre", "thinking", "nation", "station", "thunder", "stream", "freedom", "trackway", "farmers",
              "adulthood", "windows", "alphabet", "cheaper", "adsorption", "spare", "better", "shop", "pillar", "castle",
              "thereon", "another", "together", "attention", "northern", "thousand", "ration", "tension", "tearoom", "heron",
              "whether", "athens", "oration", "rested", "ending", "ingredients", "estate", "tables", "notable", "threads",
              "city-news", "green-garden", "open-source", "my-travel", "old-books", "north-east")
PREFIXES = ("", "www.", "blog.", "m.")
DOMAINS = ("com", "net", "org")
PATHS = ("/en/12", "/de/345/", "/fr/678.html", "/es/9")


def examples(spark: SparkSession) -> DataFrame:
    """url, label (1: block): each name under a prefix and domain with a path, which say nothing about the label."""
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"))
                      for label, own in ((1, BAD_NAMES), (0, GOOD_NAMES)) for name in own])
    row = spark.range(0, 1, 1, 1).select(F.explode(names).alias("x"))

    def every(parts: tuple[str, ...]) -> Column:
        return F.explode(F.array(*[F.lit(p) for p in parts]))

    row = row.select("x.*", every(PREFIXES).alias("prefix")).select("*", every(DOMAINS).alias("domain"))
    row = row.select("*", every(PATHS).alias("path"))
    # A twelfth of the combinations, the same for every name.
    turn = F.length("prefix") + F.length("path") + F.when(F.col("domain") == "com", 1).when(F.col("domain") == "net", 2).otherwise(3)
    return row.where(turn % 12 == 0).select(F.concat(F.lit("https://"), "prefix", "name", F.lit(".example."), "domain", "path")
                                           .alias("url"), "label")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(own_host: Column, own_path: Column, rules=RULES) -> Column:
    """verdict and rule of the longest rule that fits, as a struct; null if none does."""
    out = F.lit(None)
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((own_host == domain) | own_host.endswith(f".{domain}")) & own_path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column) -> Column:
    """The distinct buckets of the text's n-grams, as an array of int."""
    parts = [F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))),
        lambda i, n=n: F.pmod(F.crc32(F.encode(F.substring(text, i, F.lit(n)), "UTF-8")), F.lit(BUCKETS)).cast("int")))
        .otherwise(F.array().cast("array<int>")) for n in SIZES]
    return F.array_distinct(F.flatten(F.array(*parts)))


def features(url: Column) -> Column:
    """n-grams of host and path; the host's ends are marked so that its edges count."""
    return F.when(host(url) == "", F.array().cast("array<int>")).otherwise(
        grams(F.concat(F.lit("^"), host(url), F.lit("$"), path(url))))


def margin(weights: Column, buckets: Column) -> Column:
    """Weights of the buckets, scaled by the URL's length, plus the bias (the last weight)."""
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(weights, b))
    return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1))) + F.get(weights, F.lit(BUCKETS))


# One step over all URLs: every URL's error (by class size), then every weight's change. A URL is (y, places of its
# buckets among those that occur), a holder list has the URLs of one such bucket; the last weight is the bias.
_ERRORS = """
    transform(urls, u -> (1 / (1 + exp(-(u.scale * aggregate(u.places, 0.0D, (s, p) -> s + w[p]) + w[size(holders)])))
        - u.y) / if(u.y = 1, ones, zeros))"""
_CHANGE = """
    concat(transform(holders, (h, k) -> w[k] - {rate}D * ({decay}D * w[k]
               + aggregate(h, 0.0D, (s, i) -> s + scales[i] * e[i]))),
           array(w[size(holders)] - {bias}D * aggregate(e, 0.0D, (s, x) -> s + x)))"""
_LEARN = f"""
    aggregate(sequence(1, {STEPS}), array_repeat(0.0D, size(holders) + 1),
              (w, t) -> transform(array({_ERRORS}), e -> {_CHANGE.format(rate=RATE, bias=BIAS_RATE, decay=DECAY)})[0])"""


def train(labelled: DataFrame) -> DataFrame:
    """One row, one column ``weights``, from a small table of url and label (0 or 1, other rows are ignored).

    Gradient descent on the logistic loss, in which both classes weigh the same, with weight decay. The table becomes
    one row of arrays, so it must be small (some thousands of URLs).
    """
    spark = labelled.sparkSession
    urls = labelled.where("label in (0, 1)").select(F.col("label").cast("double").alias("y"), "url")
    urls = urls.agg(F.array_sort(F.collect_list(F.struct("url", "y"))).alias("urls")).select(
        F.posexplode("urls").alias("i", "u")).select("i", F.col("u.y").alias("y"), features(F.col("u.url")).alias("x"))
    entries = urls.select("i", F.explode("x").alias("bucket"))
    holders = entries.groupBy("bucket").agg(F.sort_array(F.collect_list("i")).alias("holders"))
    holders = holders.agg(F.sort_array(F.collect_list(F.struct("bucket", "holders"))).alias("all"))
    places = holders.select(F.posexplode("all").alias("place", "h")).select("place", F.col("h.bucket").alias("bucket"))
    placed = entries.join(places, "bucket").groupBy("i").agg(F.sort_array(F.collect_list("place")).alias("places"))
    rows = urls.join(placed, "i", "left").select("i", F.struct(
        "y", F.coalesce("places", F.array().cast("array<int>")).alias("places"),
        (1 / F.sqrt(F.greatest(F.size("x"), F.lit(1)))).alias("scale")).alias("u"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("i", "u"))).alias("urls"))
    table = holders.select(F.col("all.holders").alias("holders"), F.col("all.bucket").alias("buckets"),
                           rows.select(F.col("urls.u")).scalar().alias("urls"))
    table = table.select("*", F.col("urls.scale").alias("scales"), F.expr("greatest(1.0D, aggregate(urls, 0.0D, (s, u) -> s + u.y))").alias("ones"),
                         F.expr("greatest(1.0D, aggregate(urls, 0.0D, (s, u) -> s + 1 - u.y))").alias("zeros"))
    # Stored, so that its arrays are plain columns and not computed anew at every use in the steps below.
    folder = work_folder(spark, "urls")
    table = stored(table, f"{folder}/table")
    learnt = table.select("buckets", F.expr(_LEARN).alias("w")).select("buckets", F.posexplode("w").alias("place", "weight"))
    learnt = learnt.select(F.coalesce(F.get("buckets", F.col("place")), F.lit(BUCKETS)).cast("long").alias("id"), "weight")
    every = spark.range(0, BUCKETS + 1, 1, 1).join(learnt, "id", "left").select(
        F.struct("id", F.coalesce("weight", F.lit(0.0)).alias("weight")).alias("w"))
    every = every.agg(F.sort_array(F.collect_list("w")).alias("w"))
    return stored(every.select(F.col("w.weight").alias("weights")), f"{folder}/weights")


def judge(pages: DataFrame, weights: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (columns page_id and url).

    ``weights`` is what ``train`` gives. The score is the model's probability of block, whatever the rules say.
    """
    url = F.col("`url`")
    rows = pages.select(F.col("`page_id`").alias("page_id"), host(url).alias("host"), path(url).alias("path"),
                        features(url).alias("buckets"))
    rows = rows.select("*", rule(F.col("host"), F.col("path"), rules).alias("fit"), weights.scalar().alias("weights"))
    rows = rows.withColumn("margin", margin(F.col("weights"), F.col("buckets")))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-F.col("margin"))))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
