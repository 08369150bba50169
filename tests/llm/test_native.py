import hashlib
import random
import re

from tessera.llm import exact_dedup as dedup
from tessera.llm import url_filter as urls


def test_exact_dedup_matches_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \t", "a b", "ab", " a\x0bb ", "A b", "a\u00a0b", "x" * 50000, "x" * 49999 + " x"]
    rows = [(i, rnd.choice(texts)) for i in range(300)] + [(5, "ab"), (5, "ab"), (None, "ab"), (None, "solo")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(7)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        keep = min(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((repr(i), repr(keep), len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [(repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in dedup.exact_dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert dedup.exact_dedup(docs.limit(0)).count() == 0
    kept = dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert {norm(r.text) for r in kept.collect()} == set(groups)


def test_negative_and_large_ids(spark):
    rows = [(-(2**63), "q"), (2**63 - 1, "q"), (-1, "r"), (0, "r"), (7, "r  ")]
    got = {r.doc_id: r.keep_id for r in dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-(2**63): -(2**63), 2**63 - 1: -(2**63), -1: 7, 0: 7, 7: 7}


def slow_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter_matches_brute_force(spark):
    rules = [*urls.RULES, ("block", "a.b.net", ""), ("allow", "b.net", "/x"), ("block", "b.net", "/xy/z"), ("block", "org", "/fr/"), ("allow", "é.net", "/ü")]
    some = [None, "", "nothing", "http://", "://NET/", "http://net", "http://NET/", "http://xnet/", "http://a.example.net/en/1?q=/", "https://example.net/EN/", "ftp://x.example.com/de/#f", "http://m.org/fr/",
            "http://org/fr", "http://q.a.b.net", "http://b.net/xy/z/1", "http://b.net/x", "http://é.net/üa", "http://u@b.net:80/x", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "x://y://net/", "http://..net/", "http://net./"]
    rows = [(i % 17 or None, u) for i, u in enumerate(some * 3)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, path string")
    for use in (urls.RULES, rules, []):
        got = [(repr(r.page_id), r.host, r.path, repr(r.rule), r.verdict) for r in urls.url_filter(pages, urls.rules_frame(spark, use)).collect()]
        want = [(repr(i), h, p, repr(r), v) for i, u in rows for h, p, r, v in [slow_verdict(u, use)]]
        assert sorted(got) == sorted(want)
    assert urls.url_filter(pages.limit(0), urls.rules_frame(spark)).count() == 0


def test_keep_unique_with_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (0, "c"), (None, "d"), (None, "d"), (None, "c"), (2, "e"), (2, "e ")]
    kept = dedup.keep_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in kept) == [("0", "c"), ("1", "a b"), ("2", "e "), ("None", "d")]
