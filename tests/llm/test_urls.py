"""URL rules against a loop over all rules."""

from __future__ import annotations

import random
import re

from kithgraph.llm import urls


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in rules:
        if rule is None:
            continue
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            rank = (len(rule), len(h), verdict == "block", rule)
            best = max(best, (rank, rule, verdict)) if best else (rank, rule, verdict)
    return host, path, best[1] if best else None, best[2] if best else "allow"


RULES = [("net/", "block"), ("a.net/x/", "allow"), ("b.a.net/", "block"), ("org/fr/", "allow"), ("org/fr/", "block"), ("com/a/b/c/", "block"), ("ü.de/é/", "block"), (None, "block")]


def test_agrees_with_brute_force(spark):
    rng = random.Random(5)
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "http://net"), (6, "http://NET/"), (7, "http://Net?q=/x/"), (8, "x://a.net/x/y://z"),
             (9, "http://a.net/x"), (10, "http://ü.de/é/1"), (11, "http://u:p@b.a.net:80/"), (12, "http://.net//"), (13, "http://a\n.net/x/"), (14, "ftp://a..net/" + "d/" * 3000)]
    pages += [(20 + i, f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(rng.choices(['a', 'b', 'net', 'org', 'com', 'NET'], k=rng.randint(1, 4)))}"
                       f"{''.join('/' + rng.choice(['a', 'b', 'c', 'x', 'fr', '']) for _ in range(rng.randint(0, 5)))}{rng.choice(['', '?a/b', '#t', '/'])}") for i in range(300)]
    pages += pages[-3:] + [(None, "http://a.net/x/")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id int, url string, rule string").repartition(3)
    got = urls.judge(df, spark.createDataFrame(RULES, "rule string, verdict string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((i, *brute(u, RULES))) for i, u in pages)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id int, url string")
    assert [tuple(r) for r in urls.judge(pages, none, default="block").collect()] == [(1, "a.b", "/", None, "block")]
    assert urls.judge(pages.limit(0), none).collect() == []
