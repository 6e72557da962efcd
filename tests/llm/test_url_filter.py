"""Operator 12 against a plain reading of the rules, and its cascades against sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.llm import url_filter
from tests.compare import both, connection
from tests.llm.conftest import SF

COLUMNS = ["page_id", "host", "path", "rule", "verdict"]
ODD = [None, "", "no scheme", "http://", "http:///en/", "://net/", "HTTP://A.Example.NET/EN/x", "https://example.net/en/", "https://x.example.net/en", "https://x.example.net/en/a?b#c", "http://fooexample.net/en/", "http://net/", "http://net", "http://a.net?x=/en/", "http://a.net#/", "http://example.com/de/", "http://example.com/en/", "http://m.example.com/de/?q", "http://example.org/fr/", "http://org/fr/", "http://a.b.c.d.org/fr/x", "http://example.org./fr/", "http://u@a.net:80/", "http://ÄX.net/é", "x://y://z.net/", "http://casino.example.org/", "http://a-pills.org/x", "http://pillsy.org/", "http://" + "a." * 3000 + "net/" + "x" * 9000, "http://a.net/\n?"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain(pages, rules, blocked):
    for page_id, url in pages:
        host, path = parts(url)
        fits = lambda h: ("." + host).endswith("." + h)
        found = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and fits(h) and path.startswith(p)]
        if found:
            best = max(found)[:3]
            verdict = "block" if any(x[:3] == best and x[3] == "block" for x in found) else "allow"
            yield page_id, host, path, best[2], verdict
        else:
            yield page_id, host, path, None, "block" if any(fits(h) for h in blocked) else "allow"


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def pages_of(folder):
    t = pq.read_table(f"{folder}/pages.parquet")
    return list(zip(t["page_id"].to_pylist(), t["url"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    urls = [*ODD, *ODD[:9]]
    ids = [*range(len(urls) - 1), None]
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": urls, "html": [None] * len(urls), "host": ["x"] * len(urls), "rule": ["net/"] * len(urls), "size": [1] * len(urls)}), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_query_follows_the_rules(spark, odd_pages, where):
    folder = {"sf": SF, "odd": odd_pages}[where]
    pages = pages_of(folder)
    blocked = {h for h in (parts(u)[0] for _, u in pages) if re.search(url_filter.WORD, h)}
    assert rows(url_filter.query(spark, folder)) == sorted(plain(pages, url_filter.RULES, blocked), key=str)


def test_sql_gives_the_rows_of_odd_urls(spark, odd_pages):
    c = connection(SF)
    c.execute(f"create or replace view pages as select * from read_parquet('{odd_pages}/pages.parquet')")
    ours, theirs = both(spark, c, url_filter.query, url_filter.SQL, odd_pages)
    assert ours == theirs


def test_many_rules_in_many_shards_and_passes(spark):
    rng = random.Random(7)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice(["/", "x", "y", "/x"]) for _ in range(rng.randrange(0, 4)))
    rules = [(host(), p if (p := path()).startswith("/") or not p else "/" + p, rng.choice(["block", "allow"])) for _ in range(60)]
    blocked = [host() for _ in range(12)]
    pages = [(i, f"http://{host()}/{path()}") for i in range(600)]
    want = sorted(plain(pages, rules, blocked), key=str)
    df = spark.createDataFrame(pages, "page_id long, url string")
    given = spark.createDataFrame([*rules, ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([(h,) for h in [*blocked, None, ""]], "host string")
    for most_bytes in (1 << 25, 40):
        assert rows(url_filter.judge(df, given, listed, keys_a_shard=50, most_bytes=most_bytes)) == want


def test_no_rules_and_no_rows(spark):
    none, hosts = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "host string")
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(df, none, hosts).collect()] == ["allow"] * 3
    rules = spark.createDataFrame(url_filter.RULES, none.schema)
    assert url_filter.judge(df.limit(0), rules, hosts).count() == 0


@pytest.mark.parametrize("listed, others", [(0, 50), (50, 0), (1, 20_000), (500, 20_000), (20_000, 500)])
def test_cascade_is_exact(listed, others):
    keys = np.random.default_rng(listed).integers(0, 2**63, (listed + others, 2)).view(np.uint64)
    levels = url_filter.cascade(keys[:listed], keys[listed:])
    assert url_filter.members(levels, keys).tolist() == [True] * listed + [False] * others
    if listed == 500:
        assert 8 * sum(len(f.bits) for f in levels) < 14 * listed


def test_universe_has_every_key_of_the_corpus(spark):
    urls = spark.read.parquet(f"{SF}/pages.parquet")
    keys = urls.select(url_filter.host_and_path(F.col("url"))[0].alias("key")).distinct()
    names = sorted(r.key for r in keys.collect())
    lists = spark.createDataFrame([(n, 0) for n in names[::3]], "key string, class int")
    found = url_filter.build(keys, lists, keys_a_shard=10)
    assert found.n_shards > 1 and found.filters.select("shard").distinct().count() > 1
