"""URL parts and rules against a plain version; the model on sites that it has not seen."""

import re

from pyspark.sql import functions as F

from custodia.llm import url_filter
from custodia.llm.queries import QUERIES, URL_RULES


def plain(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x", "http://example.net/en", "http://example.net/en/", "http://notexample.net/en/1",
       "http://net/", "http://x.net", "http://x.net?a=/b", "http://a.org/fr/#x", "http://org/fr/1?q", "http://x.example.com/de/1", "http://x.example.com/dex", "a://b://c/d",
       "http://É.org/fr/É?x", "http://h/" + "p" * 100_000, "http://a.example.net/\nen/", "http://[::1]:80/x", "http://user@spam-farm.example.org/en/"]


def test_whole_table_and_odd_urls(spark, sf_dir):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r.page_id: r for r in QUERIES["op1_url_filter"](spark, sf_dir).collect()}
    weights = url_filter.train(url_filter.labelled_urls(spark))
    odd = spark.createDataFrame([(-i - 1, u, "mine") for i, u in enumerate(ODD)], "page_id long, url string, host string")
    more = url_filter.judge(odd, URL_RULES, weights)
    assert more.columns == ["page_id", "url", "host", "path", "rule", "score", "verdict"]
    got |= {r.page_id: r for r in more.collect()}
    rows += [(-i - 1, u) for i, u in enumerate(ODD)]
    assert len(got) == len(rows)
    for key, url in rows:
        host, path, best = plain(url)
        r = got[key]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), url
        assert r.verdict == (best[0] if best else "block" if r.score >= 0.5 else "allow")


def test_unseen_sites(spark):
    bad = ["spam-farming", "cheap-pill-store", "casino-royale-bonus", "free-spam", "pills-online", "adult-videos", "poker-casino", "loans-payday-now"]
    good = ["city-library", "weatherman", "historic-museum", "school-forum", "nationwide", "photos", "there-and-here", "opera-house"]
    rows = [(f"https://www.{n}.example.com/en/{i}", y) for y, names in ((1, bad), (0, good)) for i, n in enumerate(names)]
    weights = url_filter.train(url_filter.labelled_urls(spark))
    out = url_filter.judge(spark.createDataFrame(rows, "url string, y int"), [], weights).collect()
    assert sum((r.verdict == "block") == (r.y == 1) for r in out) >= 15


def test_training_tables_without_two_labels(spark):
    kinds = "url string, label int"
    for rows in ([], [("http://a.b/c", 1)], [(None, 1), ("http://a.b/c", None)]):
        weights = url_filter.train(spark.createDataFrame(rows, kinds))
        assert set(weights) == {0.0}
    out = url_filter.judge(spark.createDataFrame([], "url string"), URL_RULES, weights)
    assert out.count() == 0


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = QUERIES["op1_url_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([("http://a.net/x",)] * 3, "url string")
    assert url_filter.judge(df, URL_RULES, [0.0] * 9).where(F.col("verdict") == "block").count() == 3


def test_nothing_known_is_allowed(spark):
    """No host, or one that shares nothing with the labelled names: no evidence, so no block."""
    weights = url_filter.train(url_filter.labelled_urls(spark))
    hosts = ["www.scunthorpe-gov.uk", "github.example.org", "nytimes.example.com", "zzqx.org", "kqjv.net", "www.debian.example.org", "lemonde.fr", "shop.essex.ac.uk"]
    rows = [(None,), ("",), ("no scheme",), ("http://",), *[(f"https://{h}/maths",) for h in hosts], *[("http://",)] * 3]
    out = url_filter.judge(spark.createDataFrame(rows, "url string"), [], weights).collect()
    assert len(out) == len(rows) and all(r.verdict == "allow" for r in out), [(r.url, r.score) for r in out if r.verdict != "allow"]
    assert all(r.score == 0 for r in out if not r.host)


def test_scores_are_those_of_a_plain_fold(spark):
    """Training and scoring against the same gradient descent in plain Python, on the positions that Spark hashes."""
    import math

    from pyspark.sql import functions as F
    dim, step, decay, epochs = 64, 0.8, 1e-4, 3
    names = [("good-name", 0), ("bad-pills", 1), ("library", 0), ("casino", 1), ("forum", 0), ("free-money", 1)]
    df = spark.createDataFrame([(f"http://{n}.org/en/{y}", y) for n, y in names], "url string, label int")
    weights = url_filter.train(df, dim, epochs, step, decay)
    x = url_filter.features(url_filter.host(F.col("url")), url_filter.path(F.col("url")), dim)
    rows = [(set(r.x), r.label) for r in df.withColumn("x", x).orderBy(F.xxhash64("url")).collect()]
    w = [url_filter.PRIOR] + [0.0] * dim
    p = lambda s: 1 / (1 + math.exp(-(w[0] + sum(w[i] for i in s) / math.sqrt(len(s)))))
    for _ in range(epochs):
        for s, y in rows:
            e = y - p(s)
            w = [v * (1 - step * decay) + e * (step / math.sqrt(len(s)) if i in s else 0.0) for i, v in enumerate(w)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(w, weights, strict=True))
    got = url_filter.judge(df, [], weights, threshold=p(rows[0][0])).orderBy(F.xxhash64("url")).collect()
    assert all(abs(r.score - p(s)) < 1e-9 for r, (s, _) in zip(got, rows, strict=True))
    tie = url_filter.judge(df, [], [0.0] * (dim + 1)).collect()
    assert all(r.score == 0.5 and r.verdict == "block" for r in tie)
