import re

import pytest

from corefkit.llm import url_filter as op


def brute(pages):
    out = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate({k: k + 32 for k in range(65, 91)})
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [(len(t), t, v) for v, t in op.RULES
                if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, None, None))
        listed = bool(set(re.split(r"[.-]", host)) & set(op.BLOCK_TERMS))
        out.append((i, host, path, rule, verdict or ("block" if listed else "allow")))
    return sorted(out, key=str)


def make_pages():
    urls = [None, "", "no scheme", "://", "http://", "https://Example.COM/en/x", "http://www.example.com/en/?q", "http://a.b.net/es/",
            "http://net/fr/x#y", "http://xnet/fr/", "http://com", "http://com/", "http://x.com?/en/", "ftp://a://b/c",
            "http://example.com/en", "http://ads.example.org/\nx", "http://É.org/ß?x", "http://casino-7.org/", "http://WIN.org/a/b"]
    urls += [f"http://{'casino-' if k % 3 == 0 else ''}h{k}.example.org/p{k}" for k in range(600)] + urls[:8]
    return [(k if k % 50 else None, u) for k, u in enumerate(urls)]


@pytest.mark.parametrize("shard_keys", [op.SHARD_KEYS, 40])
def test_equals_brute_force(spark, shard_keys):
    pages = make_pages()
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, listed string")
    got = op.judge_urls(df, shard_keys=shard_keys)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages)


@pytest.mark.parametrize("shard_keys", [op.SHARD_KEYS, 200])
def test_the_cascade_is_exact_with_tiny_filters(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(op, "BITS_PER_KEY", 2)
    keys = spark.range(3000).selectExpr("concat('k', id) as key", "id % 4 = 0 as listed")
    cascade = op.build_cascade(keys, shard_keys)
    assert len(cascade.levels) > 3 and cascade.shards == (1 if shard_keys > 3000 else 4)
    wrong = keys.where(cascade.is_listed(keys["key"]) != keys["listed"])
    assert wrong.count() == 0


def test_a_million_listed_keys(spark):
    import time

    began = time.time()
    keys = spark.range(2_000_000).selectExpr("concat('host', id, '.org') as key", "id % 2 = 0 as listed")
    cascade = op.build_cascade(keys, 1 << 18)
    assert cascade.shards == 4
    wrong = keys.where(cascade.is_listed(keys["key"]) != keys["listed"])
    assert wrong.count() == 0
    assert time.time() - began < 60


def test_a_table_of_listed_hosts(spark):
    pages = make_pages()
    df = spark.createDataFrame(pages, "page_id long, url string")
    listed = spark.createDataFrame([("h1.example.org",), ("h2.example.org",), ("h2.example.org",), ("",), ("nowhere.org",)], "host string")
    got = {(r.page_id, r.host): r.verdict for r in op.judge_urls(df, rules=(), listed=listed).collect()}
    assert {h for (_, h), v in got.items() if v == "block"} == {"h1.example.org", "h2.example.org"}


def test_nothing_listed_and_empty_table(spark):
    none = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert op.judge_urls(none).first().verdict == "allow"
    assert op.judge_urls(none.where("page_id > 1")).count() == 0


def test_native(spark):
    plan = op.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
