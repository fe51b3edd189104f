import random

import pytest

from cutpoint.llm import queries, urls

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, host string, path string, rule string, top string, key string, c_host string"


def split(url):
    """Host and path by the definition."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def pages_of(spark, addresses):
    return spark.createDataFrame([(i, u, "x", "y", "z", "t", "k", "c") for i, u in enumerate(addresses)], PAGES)


ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://Sub.ORG/ES/a", "http://org", "http://org?x=/es/", "http://org#/es/", "http://a..org/es/",
    "http://org./es/", "http://.org/es/", "a://b://org/es/", "http://xorg/es/", "http://org/es", "http://org/es/\n/x?y#z", "http://Ä.org/es/",
    "http://a.b.c.d.e.f.org/es/en/1", "http://" + "x." * 400 + "org/es/" + "p" * 5000, "http://user@org:80/es/", "http://org/es/", "http://org/es/",
]


@pytest.mark.parametrize("one_task", [True, False])
def test_rules_equal_brute_force(spark, one_task, monkeypatch):
    if not one_task:
        monkeypatch.setattr(urls, "ONE_TASK_ROWS", 0)
        monkeypatch.setattr(urls, "BROADCAST_CELLS", 0)
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "org", "x-y"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "b", "/ab", "é"]) for _ in range(rng.randint(0, 5)))
    rules = {(host(), p if p.startswith("/") else "/" + p): rng.choice(["allow", "block"]) for p in (path() for _ in range(120))}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("org", "/es/", "block"), ("b", "", "block")]
    addresses = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(400)] + ODD
    got = urls.judge_urls(pages_of(spark, addresses).repartition(3), spark.createDataFrame(rules, RULES)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged(u, rules) for i, u in enumerate(addresses)}
    assert sum(r.rule is not None for r in got) > 50


def test_odd_rules(spark):
    pages = pages_of(spark, ["http://a.org/x", "http://b.com/"])
    rules = [("org", "/", "allow"), ("org", "/", "block"), ("ORG", "/x", "allow"), (None, "/", "block"), ("com", None, "block"), ("com", "/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, spark.createDataFrame(rules, RULES), default="block").collect()}
    assert got == {0: ("org/x", "allow"), 1: (None, "block")}
    got = urls.judge_urls(pages, spark.createDataFrame(rules[:2], RULES)).collect()
    assert {r.verdict for r in got if r.rule} == {"block"}


def test_empty_tables_and_equal_rows(spark):
    rules = spark.createDataFrame([("org", "/", "block")], RULES)
    assert urls.judge_urls(pages_of(spark, []), rules).count() == 0
    got = urls.judge_urls(pages_of(spark, ["http://a.org/"] * 3), spark.createDataFrame([], RULES)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 3
    same = spark.createDataFrame([(None, "http://a.org/")] * 3, "page_id long, url string")
    assert [(r.page_id, r.verdict) for r in urls.judge_urls(same, rules).collect()] == [(None, "block")] * 3


def test_no_python_on_executors(spark, sf_dir):
    plan = queries.op12_urls(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan
