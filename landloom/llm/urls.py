"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table (at most ``LABELLED`` rows are read, by hash) by batch gradient
descent with momentum and a ridge, in its dual form: started from zero, the weights stay a combination of the training
rows, so the descent needs only their Gram matrix, and runs as one fold over one row.  The primal weights, one per hash bucket, are the
bounded table that scores every URL.

Rows: a URL that is null or has no ``://`` has empty host and path; it fits no rule and is judged by the model's constant;
null ids stay; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.  Without
labelled rows the model allows everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

BUCKETS, GRAMS, LABELLED, STEPS, RATE, MOMENTUM, RIDGE = 4096, (3, 4), 512, 40, 4.0, 0.9, 0.0003

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Words of names that are blocked and allowed; each name is two of them, or made-up syllables for names without meaning.
LURES = ("free", "cheap", "best", "hot", "win", "fast", "adult", "ads")
WARES = ("casino", "poker", "bets", "slots", "pills", "pharma", "replica", "dating", "xxx", "loans", "prize", "crack", "track", "popup", "bonus", "jackpot")
PLACES = ("city", "river", "north", "green", "open", "little", "daily", "old")
THINGS = ("library", "garden", "school", "museum", "weather", "kitchen", "history", "journal", "hospital", "music", "science", "travel", "bakery", "choir", "archive", "market")
SYLLABLES = ("ba", "cor", "dun", "el", "fi", "gar", "hol", "jen", "ka", "lum", "mi", "nor", "sha", "sto", "the", "vo")


def labelled_urls() -> list[tuple[int, str]]:
    """The labelled table (label 1: block, url), made by rule from the words above: both labels have the same prefixes,
    endings and paths, so that only names tell them apart."""
    prefixes, paths = ("", "www.", "m.", "blog."), ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2", "/{}#top")
    blocked = [f"{a}-{b}" if j % 3 else f"{b}-{a}" for k, b in enumerate(WARES) for j in range(6) if (a := LURES[(k + j) % 8])]
    allowed = [f"{a}{'-' if (j + k) % 2 else ''}{b}" for k, b in enumerate(THINGS) for j in range(3) if (a := PLACES[(k + 3 * j) % 8])]
    allowed += [a + SYLLABLES[(3 * k + j) % 16] + SYLLABLES[(7 * k + 5 * j) % 16] for k, a in enumerate(SYLLABLES) for j in range(6)]
    out = []
    for label, names in ((1, blocked), (0, allowed)):
        for name in names:
            n = zlib.crc32(name.encode())  # what stands around a name depends on nothing but the name
            out.append((label, f"http{'s' if n % 2 else ''}://{prefixes[n // 2 % 4]}{name}.{('test', 'example', 'invalid')[n // 8 % 3]}{paths[n // 24 % 6].format(n % 9000 + 1000)}"))
    return out


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams_of(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of host and path, each text marked and closed at both ends."""

    def own(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.conv(F.substring(F.md5(F.substring(text, i, F.lit(n)).cast("binary")), 1, 3), 16, 10).cast("int"))

    host, path = F.concat(F.lit("h^^^"), host, F.lit("$$$")), F.concat(F.lit("p^^^"), path, F.lit("$$$"))
    return F.concat(*(own(text, n) for text in (host, path) for n in GRAMS))


def _scale(grams: Column) -> Column:
    """What a URL's bucket counts are divided by, in training and in scoring."""
    return F.sqrt(F.greatest(F.size(grams), F.lit(1)))


def train(labelled: DataFrame) -> list[float]:
    """labelled(url, label) -> the weight of each bucket and, last, the constant."""
    rows = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(LABELLED)
    seen = rows.select("label", grams_of(host_of(F.col("url")), path_of(F.col("url"))).alias("g"))
    counts = F.transform(F.array_sort(F.array_distinct("g")), lambda b: F.struct(b.alias("b"), F.size(F.filter("g", lambda x: x == b)).cast("double").alias("n")))
    counted = seen.select("label", counts.alias("c"), _scale(F.col("g")).alias("scale"))
    place = F.row_number().over(Window.orderBy("y", "c"))  # LABELLED rows
    x = counted.select(F.col("label").cast("double").alias("y"), "c", "scale").withColumn("i", place)
    one = F.array(F.struct(F.lit(BUCKETS).alias("b"), F.col("scale").alias("n")))  # the constant is a bucket of its own, of value 1
    entries = x.select("i", "y", "scale", F.explode(F.concat("c", one)).alias("e")).select("i", "y", F.col("e.b").alias("b"), (F.col("e.n") / F.col("scale")).alias("v"))
    dots = entries.join(entries.select(F.col("i").alias("j"), "b", F.col("v").alias("u")), "b").groupBy("i", "y", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    lines = dots.groupBy("i", "y").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("line"))  # LABELLED entries at most, as below
    gram = lines.agg(F.array_sort(F.collect_list(F.struct("i", "y", "line"))).alias("lines"))
    gram = gram.select(F.transform("lines", lambda r: F.transform(r["line"], lambda e: e["k"])).alias("k"), F.transform("lines", lambda r: r["y"]).alias("y"))

    def step(state, _):
        margins = F.transform("k", lambda k: F.aggregate(F.zip_with(k, state["alpha"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
        pull = F.zip_with(F.zip_with("y", margins, lambda y, m: (y - 1 / (1 + F.exp(-m))) / F.size("y")), state["alpha"], lambda g, a: RATE * (g - RIDGE * a))
        speed = F.zip_with(state["speed"], pull, lambda v, g: MOMENTUM * v + g)
        return F.struct(F.zip_with(state["alpha"], speed, lambda a, v: a + v).alias("alpha"), speed.alias("speed"))

    still = F.transform("y", lambda y: F.lit(0.0))
    fitted = gram.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(still.alias("alpha"), still.alias("speed")), step, lambda s: s["alpha"]).alias("alpha"))
    alpha = fitted.select(F.posexplode("alpha").alias("at", "a")).select((F.col("at") + 1).alias("i"), "a")
    out = [0.0] * (BUCKETS + 1)
    for r in entries.join(alpha, "i").groupBy("b").agg(F.sum(F.col("a") * F.col("v")).alias("w")).collect():  # BUCKETS + 1 rows
        out[r.b] = r.w
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row."""
    weight = train(labelled)
    table_ = F.lit(weight[:BUCKETS])
    own = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    g = own.withColumn("g", grams_of(F.col("host"), F.col("path"))).withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    total = F.aggregate("g", F.lit(0.0), lambda s, b: s + F.element_at(table_, b + 1)) / _scale(F.col("g")) + weight[BUCKETS]
    blank = (F.col("host") == "") & (F.col("path") == "")
    margin = F.when(blank, F.lit(weight[BUCKETS])).otherwise(total)
    return g.withColumn("margin", margin).select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce("fits.verdict", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"),
        F.round(1 / (1 + F.exp(-F.col("margin"))), 6).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(labelled_urls(), "label int, url string"))
