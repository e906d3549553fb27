"""URL filtering with prefix rules and a classifier, in DataFrame operations only.

A URL is judged by the longest rule that fits its host and path. Where no rule fits, a logistic
regression on hashed character n-grams of host and path decides; it is trained from a small labelled
URL table: one made here by rule from word lists, or one that the caller passes. Judging is one
projection over the table: no shuffle, nothing broadcast but the coefficients (2**14 doubles).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Rows of a labelled table that a fit uses at most (those with the least hashes of the URL).
MAX_LABELLED = 50_000
MADE_UP = 2500

# Words that mark URLs to block, words of ordinary sites, ordinary names that hold a blocked word, and
# how hosts and paths are made of them.
BLOCK_WORDS = (
    "casino", "bet", "bets", "betting", "poker", "slots", "jackpot", "roulette", "pills", "pharma", "viagra", "cialis", "porn", "xxx", "sex", "adult",
    "escort", "loan", "loans", "payday", "cheap", "replica", "spam", "farm", "ads", "track", "tracker", "click", "popup", "free",
    "win", "prize", "lottery", "warez", "crack", "keygen", "torrent", "miner", "phish", "malware", "clickbait", "nude", "cams", "hookup",
)
ALLOW_WORDS = (
    "news", "blog", "docs", "wiki", "university", "library", "museum", "science", "journal", "weather", "health", "school", "city",
    "garden", "recipes", "travel", "history", "music", "sports", "forum", "support", "developer", "research", "books", "theatre",
    "house", "river", "stone", "north", "green", "gazette", "county", "council", "hospital", "church", "photo", "art", "energy", "bank",
    "market", "radio", "studio", "kitchen", "bike", "railway", "coffee", "data", "open", "learn", "work", "legal", "family", "planet",
    "nature", "ocean", "mountain", "bread", "paper", "pixel", "robot", "cloud", "maps", "times", "post", "review", "today", "world",
)
LOOKALIKES = (
    "essex", "sussex", "middlesex", "sextant", "winchester", "windsor", "winter", "window", "darwin", "baldwin", "twins", "wine", "farmer", "farmers", "farmhouse",
    "pharmacy", "alphabet", "better", "elizabeth", "diabetes", "tibet", "between", "adulthood", "adultswim", "freedom", "freeman", "freestyle", "gluten-free", "soundtrack", "racetrack",
    "tracks", "trackandfield", "headsets", "roads", "adsorption", "heads", "uploads", "nobelprize", "crackers", "firecracker", "minerals", "examiner", "cheapside", "slotcar", "pokerface",
    "clicker", "doubleclick-history", "spamalot", "loanwords", "torrential", "escorted-tours", "replicate", "scamper", "webcams", "campus", "denuded", "sexology", "pillsbury", "caterpillars",
)
FILLERS = ("x", "xx", "24", "247", "365", "online", "best", "top", "hot", "now", "hub", "zone", "club", "vip")
#: Frequent letter pairs: most names of hosts are no words.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce")
ENDS = (".com", ".net", ".org", ".co.uk", ".de", ".fr", ".es", ".io", ".info", ".example.com", ".example.net", ".example.org")
SCHOLARLY = (".ac.uk", ".edu", ".gov", ".museum", ".org", ".com", ".co.uk", ".net")
LANGS = ("en", "de", "fr", "es")
BLOCK_PATHS = ("/{l}/{n}", "/", "/{w}/{n}", "/{l}/{w}-{v}.html", "/go/{w}?id={n}", "/free-{w}", "/{w}-bonus/{n}")
ALLOW_PATHS = ("/{l}/{n}", "/", "/{w}/{n}", "/{l}/{w}-{v}.html", "/2021/05/{w}", "/wiki/{w}", "/about/{v}", "/{v}/index.php", "/static/{w}.pdf")


def labelled_urls(spark: SparkSession, without: int | None = None, only: int | None = None) -> DataFrame:
    """``(url, label)``, label 1 to block, made by rule from the word lists.

    Blocked hosts are a blocked word alone, or with another one or an ordinary word; allowed hosts are
    ordinary words, look-alikes and made-up names, alone or joined. Ends and paths vary on both sides. ``without`` and ``only`` leave out, or
    keep, the hosts of every fifth word of each list (those whose place leaves this remainder): a
    held-out part whose words were never seen.
    """

    def kept(words):
        return [w for k, w in enumerate(words) if (without is None or k % 5 != without) and (only is None or k % 5 == only)]

    block, allow, alike = kept(BLOCK_WORDS), kept(ALLOW_WORDS), kept(LOOKALIKES)

    def side(first, second, label, ends, paths, seed, copies):
        n = len(first) * copies
        one = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(len(options))).cast("int") + 1)
        lead = F.element_at(F.array(*[F.lit(w) for w in first]), (F.col("id") % len(first) + 1).cast("int"))
        other = one(second, 1)
        name = F.concat(lead, one(("-", "", "."), 2), other)
        turned = F.concat(other, one(("-", "", "."), 2), lead)
        shape = F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "id"), F.lit(3))
        host = F.concat(one(("", "", "www.", "m.", "blog."), 4), F.when(shape == 0, lead).when(shape == 1, name).otherwise(turned), one(ends, 5))
        path = one(paths, 6)
        for mark, text in (("{l}", one(LANGS, 7)), ("{n}", F.pmod(F.xxhash64(F.lit(seed), F.lit(8), "id"), F.lit(1000)).cast("string")), ("{w}", one(first, 9)), ("{v}", one(ALLOW_WORDS, 10))):
            path = F.replace(path, F.lit(mark), text)
        return spark.range(n).select(F.concat(F.lit("https://"), host, path).alias("url"), F.lit(float(label)).alias("label"))

    rows = side(block, block, 1, ENDS, BLOCK_PATHS, 1, 30).union(side(block, allow, 1, ENDS, BLOCK_PATHS, 2, 20)).union(side(block, FILLERS, 1, ENDS, BLOCK_PATHS, 9, 20))
    rows = rows.union(side(allow, FILLERS, 0, ENDS, ALLOW_PATHS, 10, 8))
    for k, ends in enumerate((ENDS, SCHOLARLY)):
        rows = rows.union(side(allow, allow, 0, ends, ALLOW_PATHS, 3 + k, 16)).union(side(alike, allow, 0, ends, ALLOW_PATHS, 5 + k, 16)).union(side(alike, alike, 0, ends, ALLOW_PATHS, 7 + k, 4))
    draw = lambda k: F.element_at(F.array(*[F.lit(p) for p in PAIRS]), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(PAIRS))).cast("int") + 1)
    parts = [draw(k) if k < 3 else F.when(F.pmod(F.xxhash64(F.lit(-k), "id"), F.lit(2)) == 0, draw(k)).otherwise(F.lit("")) for k in range(5)]
    pick = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(options))).cast("int") + 1)
    made_up = F.concat(F.lit("https://"), pick(("", "", "www.", "m.", "blog."), 11), *parts, pick(ENDS, 12), F.lit("/"), pick(LANGS, 13), F.lit("/"), F.col("id") % 1000)
    return rows.union(spark.range(MADE_UP).select(made_up.alias("url"), F.lit(0.0).alias("label")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams, marked by the part that they come from. Path digits count as one sign."""
    def cut(mark: str, text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.concat(F.lit(mark), F.substring(text, at, F.lit(n))))

    ends = lambda text: F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.concat(*[cut("h:", ends(host), n) for n in sizes], *[cut("p:", ends(F.regexp_replace(path, "[0-9]+", "0")), n) for n in sizes]))


def _vectors(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    split = urls.withColumn("__host", host).withColumn("__path", path)
    split = split.withColumn("__grams", _grams(F.col("__host"), F.col("__path")))
    return HashingTF(inputCol="__grams", outputCol="__vector", numFeatures=BUCKETS, binary=True).transform(split)


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit on ``(url, label)``; rows with a null label are left out."""
    rows = labelled.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED).select("url", F.col("label").cast("double").alias("label"))
    return LogisticRegression(featuresCol="__vector", labelCol="label", regParam=0.002, maxIter=40, standardization=False, aggregationDepth=2).fit(_vectors(rows))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (both null if none does). ``rules``: ``(verdict, host/path)``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel, threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    ``score`` is the classifier's probability of "block" (it is computed for every row). A URL that is
    null or has no ``://`` has empty host and path, fits no rule and is left to the classifier.
    Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    scored = model.transform(_vectors(pages.select("page_id", "url")))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    score = vector_to_array("probability")[1]
    return scored.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"), F.round(score, 6).alias("score"))
