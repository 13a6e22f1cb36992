"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Rules and the labelled URL table are configuration of bounded size. Training is one expression over one
row that holds the labelled table (stochastic gradient descent as a fold), scoring is one projection;
nothing is shuffled, and no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hashed dimensions, passes over the labelled table, step size, decay of the weights, and the bound on labelled rows.
DIM, EPOCHS, STEP, DECAY, MAX_LABELLED = 2048, 12, 0.8, 1e-4, 400
#: The bias before any evidence, as log-odds; it is not learned, so that a url which tells nothing is allowed.
PRIOR = -1.5

# The small labelled table is invented: plain names of either kind, each on a few hosts and paths. There are more of
# the harmless ones, as on the web, so that a name which tells nothing is allowed.
BAD_SITES = (
    "casino-bonus", "casino-royal", "free-money", "viagra-online", "poker-win", "online-poker", "adult-cams", "payday-loans",
    "replica-watches", "xxx-videos", "hot-singles", "crypto-giveaway", "lottery-winner", "miracle-diet", "buy-followers",
    "link-farm", "spam-links", "clickbait", "cracks-warez", "slot-machines", "betting-tips", "sports-bets", "essay-mill", "fake-ids", "pills-shop", "discount-pills",
    "spam-blog", "spammers", "cheap-meds", "farm-links", "ads-server", "ad-tracker", "tracking-ads", "adult-chat", "free-spins", "win-prizes",
    "porn-tube", "sex-cams", "instant-loans", "pharma-deals", "bet-now", "spam-sender", "free-spam-mail", "cheap-rolex", "pill-mart")
GOOD_SITES = (
    "library", "university", "daily-news", "recipes", "open-science", "weather", "museum", "city-council", "gardening",
    "documentation", "history", "travel-notes", "music-archive", "health-info", "forum", "astronomy", "school", "athletics",
    "photography", "poetry", "biology", "theatre", "lantern", "station", "essex", "sussex", "middlesex", "oxford", "college",
    "mathematics", "physics", "chemistry", "institute", "government", "parliament", "ministry", "hospital", "clinic", "freedom",
    "freelance", "software", "freeware-project", "linux", "compiler", "farmers-market", "winery", "window-repair", "windsor", "darwin",
    "betty", "alphabet", "tibet", "address-book", "shadows", "lighthouse", "breads", "musical", "orchestra", "opera", "cinema", "festival",
    "bakery", "restaurant", "cooking", "mountain", "river", "forest", "harbour", "railway", "airport", "bicycle", "football", "cricket",
    "tennis", "chess", "knitting", "painting", "sculpture", "economics", "insurance", "bank", "notary", "carpenter")
PATHS = ("/en/12", "/fr/345.html", "/2024/page/", "/de/7")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: block)."""
    rows = []
    for label, sites in ((1, BAD_SITES), (0, GOOD_SITES)):
        for i, site in enumerate(sites):
            for j, (host, path) in enumerate((("www.%s.com", PATHS[i % 4]), ("%s.example.org", PATHS[(i + 1) % 4]), ("blog.%s.net", PATHS[(i + 2) % 4]))):
                rows.append((f"https://{host % site}{path}", label, i * 3 + j))
    return spark.createDataFrame(rows, "url string, label int, ord int").drop("ord")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*+", 0)
    return F.translate(raw, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*+([^?#]*+)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path) that fits: struct(len, rule, verdict), null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    fits = []
    for verdict, h, p in rules:
        on_host = (host_ == h) | host_.endswith("." + h)
        fits.append(F.when(on_host & path_.startswith(p), F.struct(
            F.lit(len(h) + len(p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def features(host_: Column, path_: Column, dim: int = DIM) -> Column:
    """Distinct hashed positions (from 1) of the 3- and 4-grams of the bounded host and of the 3-grams of the path."""
    def grams(text: Column, n: int, kind: str) -> Column:
        chars = F.split(text, "")
        spot = lambda i: F.pmod(F.xxhash64(F.lit(kind), F.array_join(F.slice(chars, i, n), "")), F.lit(dim)).cast("int") + 1
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), spot)).otherwise(
            F.array().cast("array<int>"))
    site = F.concat(F.lit("^"), host_, F.lit("$"))
    return F.array_distinct(F.concat(grams(site, 3, "h3"), grams(site, 4, "h4"), grams(path_, 3, "p3")))


def logit(x: Column, weights: Column) -> Column:
    """bias + the mean weight of the positions, scaled by the root of their number."""
    total = F.aggregate(x, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, i + 1))
    return F.element_at(weights, F.lit(1)) + F.when(F.size(x) > 0, total / F.sqrt(F.size(x))).otherwise(0.0)


def train(labelled: DataFrame, dim: int = DIM, epochs: int = EPOCHS, step: float = STEP, decay: float = DECAY,
          max_rows: int = MAX_LABELLED) -> list[float]:
    """Weights (bias first, then ``dim``) from a labelled table of url and label (1: block).

    At most ``max_rows`` rows, by hash of the url, are used; rows without url or label are not. They are
    folded in one row, in an order that mixes the labels, and only the weights reach the driver. Without
    rows, or with one label only, all weights are zero and nothing is blocked.
    """
    rows = (labelled.where("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("double").alias("y")).distinct()
            .withColumn("ord", F.xxhash64("url")).orderBy("ord", "y").limit(max_rows)
            .select("ord", "y", features(host(F.col("url")), path(F.col("url")), dim).alias("x")))
    # the step at each weight, dense: none at the bias, then the row's positions
    hit = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.when(F.array_contains("x", i), F.lit(step) / F.sqrt(F.size("x"))).otherwise(0.0))
    rows = rows.withColumn("d", F.concat(F.array(F.lit(0.0)), hit))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("ord", "y", "x", "d"))).alias("rows"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    zeros = F.array_repeat(F.lit(0.0), dim + 1)
    start = F.concat(F.array(F.lit(float(PRIOR))), F.array_repeat(F.lit(0.0), dim))

    def learn(w: Column, r: Column) -> Column:
        error = r.getField("y") - F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(r.getField("x"), w)))
        # the one-element array binds the error, which would else be computed anew for each weight
        bound = F.transform(F.array(error), lambda e: F.zip_with(w, r.getField("d"), lambda v, g: v * (1 - step * decay) + e * g))
        return F.element_at(bound, 1)

    passes = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(epochs)), lambda _: F.col("rows")))
    fit = one.select(F.when(F.col("lo") < F.col("hi"), F.aggregate(passes, start, learn)).otherwise(zeros).alias("w"))
    return fit.first()["w"]


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], threshold: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, score and verdict (allow or block); other columns stay.

    The longest fitting rule decides; without one, a score of ``threshold`` or more blocks, ties at the threshold
    included. Null urls and urls without ``://`` have an empty host and path and fit no rule; where the host is
    empty, nothing speaks against it, so its score is 0. A column of the table named like one of the results is
    replaced. Each row is judged by itself: rows that repeat stay, an empty table gives an empty one.
    """
    model = F.lit([float(w) for w in weights])
    out = urls.withColumn("__h", host(F.col("url"))).withColumn("__p", path(F.col("url")))
    fit = rule(F.col("__h"), F.col("__p"), rules) if rules else F.lit(None).cast("struct<len:int,rule:string,verdict:string>")
    out = out.withColumn("__rule", fit).withColumn("__x", features(F.col("__h"), F.col("__p"), len(weights) - 1))
    out = out.withColumn("__score", F.when(F.col("__h") == "", 0.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(F.col("__x"), model)))))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__score") >= threshold, "block").otherwise("allow"))
    names = ("host", "path", "rule", "score", "verdict")
    return out.select(*[F.col(f"`{c}`") for c in urls.columns if c not in names],
                      F.col("__h").alias("host"), F.col("__p").alias("path"), F.col("__rule.rule").alias("rule"),
                      F.col("__score").alias("score"), verdict.alias("verdict"))
