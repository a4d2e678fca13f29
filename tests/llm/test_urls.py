from __future__ import annotations

import random
import re

from typing import NamedTuple

from folioseek.llm import native_queries, urls
from folioseek.llm.native_queries import HOST_RULES

SCHEMA = "page_id bigint, url string, host string, verdict int, token string"


class Rule(NamedTuple):
    action: str
    text: str
    kind: str = "host"


RULES = [Rule(a, t) for a, t in HOST_RULES] + [
    Rule("block", "^ads^", "pattern"),
    Rule("block", "*track*", "pattern"),
    Rule("allow", "^ads^good^", "pattern"),
    Rule("block", "/x?y/", "pattern"),
]


def table(spark, rules):
    return spark.createDataFrame([(r.action, r.kind, r.text) for r in rules], "action string, kind string, rule string")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :]).group()


def pattern(text):
    """Whether a pattern rule fits, by trying every place."""
    body = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9]|^|$)"}.get(c) or re.escape(c) for c in text)
    return re.compile(body, re.DOTALL)


def plain(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for r in rules:
        if r.kind == "host":
            h, p = r.text.split("/", 1)
            fits = (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        else:
            fits = bool(pattern(r.text).search(host + path))
        if fits:
            best = max(best or (False, -1, "", ""), (r.kind == "host", len(r.text), r.text, r.action))
    named = best is not None and best[0]
    return host, path, best[2] if named else None, best[3] if best else default


def test_rules_against_every_rule_tried(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.EXAMPLE.com", "a.www.example.com", "notexample.com", "x.net", "net", "ads.org", "q.org", ""]
    paths = ["", "/", "/en/", "/en/1", "/EN/2", "/en", "/fr/9", "/es/1.html", "/ads/good/1", "/badads/", "/mytracker", "/x?y/", "//en/"]
    made = [f"{s}{h}{p}{q}" for h in hosts for p in paths for s in ("http://", "https://") for q in ("", "?a=/fr/", "#t")]
    rows = [(i, u) for i, u in enumerate(rng.sample(made, 400))]
    rows += [(900, None), (None, "http://x.net/fr/1"), (901, "no scheme"), (902, "://"), (903, "a://b://c.com/"), (904, "http://é.com/ü")]
    rows += rows[:5] + [(5000 + i, "http://hot.net/es/1") for i in range(50)] + [(6, "http://" + "a" * 40_000 + ".com/")]
    pages = spark.createDataFrame([(i, u, "h", 1, "t") for i, u in rows], SCHEMA)
    found = urls.judge(pages, table(spark, RULES)).collect()
    want = [(i, u, *plain(u, RULES)) for i, u in rows]
    key = ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(repr(tuple(r[k] for k in key)) for r in found) == sorted(map(repr, want))
    assert {r.token for r in found} == {"t"}


def test_tokens_are_whole_runs(spark):
    want = {
        ("Example.com/en/", "host"): ["com", "en", "example"],
        ("example.com/en", "host"): ["com", "example"],
        ("net", "host"): ["net"],
        ("*bad*^word^x", "pattern"): ["word"],
        ("*track*", "pattern"): [""],
        ("ads^", "pattern"): [""],
    }
    rules = urls.compiled(table(spark, [Rule("block", text, kind) for text, kind in want])).collect()
    assert {(r.rule, r.kind): r.tokens for r in rules} == want


def test_patterns_of_many_tokens_run_few_regular_expressions(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rules = [Rule(rng.choice(["allow", "block"]), f"^{a}^*^{b}^{c}*", "pattern") for a, b, c in (rng.sample(words, 3) for _ in range(150))]
    rules += [Rule("block", f"*{w}x*^{w}^", "pattern") for w in words[:20]] + RULES
    rows = [(i, f"http://{rng.choice(words)}.org/{'/'.join(rng.choices(words, k=5))}-{rng.choice(words)}x.html") for i in range(300)]
    for i, r in enumerate(rules[:60]):  # addresses that fit
        rows.append((1000 + i, "http://a.org/" + r.text.replace("^", "/").replace("*", "/q/")))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, table(spark, rules)).collect()}
    assert all(found[i] == plain(u, rules) for i, u in rows)
    assert sum(plain(u, rules)[3] == "block" for _, u in rows) > 20
    places = pages.select(urls.host("url").alias("host"), urls.path("url").alias("path")).distinct()
    run = urls.candidates(places, urls.compiled(table(spark, rules))).count()
    assert run < places.count() * len(rules) / 20


def test_rules_of_the_query(spark):
    rules = urls.compiled(native_queries.page_rules(spark)).collect()
    patterns = [r for r in rules if r.kind == "pattern"]
    assert len(patterns) >= 100 and len(rules) == len(patterns) + len(HOST_RULES)
    assert sum(len(r.tokens) > 1 for r in patterns) >= 50 and sum("*" in r.rule for r in patterns) >= 50


def test_empty_tables(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert urls.judge(pages, table(spark, RULES)).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/", "", 0, "")], SCHEMA)
    (row,) = urls.judge(some, table(spark, []), default="block").collect()
    assert (row.host, row.rule, row.verdict) == ("a.com", None, "block")
