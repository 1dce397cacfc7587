import math
import random
import re

from ledgerloom.llm import urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def pages(spark, addresses):
    rows = [(k, u, None, "x", 1) for k, u in enumerate(addresses)]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, host string, block_score int")


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/"),
        "http://example.net/en/": ("example.net", "/en/", "example.net/en/"),
        "http://example.net/en": ("example.net", "/en", "net/"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/"),
        "http://net/": ("net", "/", "net/"),
        "http://x.net": ("x.net", "", None),
        "http://x.net?q=/": ("x.net", "", None),
        "ftp://www.example.com/de/a://b/": ("www.example.com", "/de/a://b/", "example.com/de/"),
        "http://w.org/fr/1": ("w.org", "/fr/1", "org/fr/"),
        "http://w.org/FR/1": ("w.org", "/FR/1", None),
        "http://É.org/fr/": ("É.org", "/fr/", "org/fr/"),
        "no scheme.net/": ("", "", None),
        "": ("", "", None),
        "http://u\nv.net/": ("u\nv.net", "/", "net/"),
        None: ("", "", None),
    }
    out = urls.judge_urls(pages(spark, list(cases)), RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in out] == list(cases.values())
    for r in out:
        assert r["verdict"] in ("allow", "block")
        if r["rule"]:
            assert r["verdict"] == RULES[r["rule"]]


def test_trees_learn_what_labels_share(spark):
    bad = [f"http://h{k % 9}.test/a/b/c/{k}{k * 7919}?x=1&y=2&z={k}" for k in range(300)]
    good = [f"http://h{k % 9}.test/{'ab' * (k % 5)}" for k in range(300)]
    rows = pages(spark, [*bad, *good])
    ruled = urls.with_rules(rows.select("page_id", "url"), {})
    labelled = ruled.selectExpr("url", "host", "path", "int(page_id < 300) AS label")
    held = urls.with_rules(pages(spark, [
        *(f"http://new.test/q/w/e/99{k}?x=3&y=5&z=7" for k in range(20)),
        *(f"http://new.test/{'ba' * (k % 4)}" for k in range(20)), "x" * 100_000]).select(
        "page_id", "url"), {})
    out = urls.UrlModel(labelled).score(held).orderBy("page_id").collect()
    assert len(out) == 41 and all(0 <= r["block_score"] <= 1 for r in out)
    right = [(r["block_score"] > 0.5) == (r["page_id"] < 20) for r in out[:40]]
    assert sum(right) >= 38


def test_one_sided_and_missing_labels(spark):
    out = urls.judge_urls(pages(spark, ["http://a.net/", "http://b.xyz/", "http://b.xyz/"]), RULES)
    assert [r["verdict"] for r in out.orderBy("page_id").collect()] == ["block"] * 3
    none = urls.judge_urls(pages(spark, ["http://b.xyz/", None]), RULES)
    assert [r["verdict"] for r in none.collect()] == ["allow"] * 2
    assert urls.judge_urls(pages(spark, []), RULES).collect() == []


def plain(url, rules):
    """Host, path and the longest rule that fits, by plain string functions."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = []
    for rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules_against_a_plain_matcher(spark):
    r = random.Random(5)
    hosts = ["net", "example.net", "a.example.net", "EXAMPLE.com", "x.example.com", "org", "w.org", "bnet", "é.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/a", "/de/", "/DE/", "/fr/x", "/fr", "//en/", "/fr/" + "y" * 50_000]
    tails = ["", "?a=1&b=2", "#f", "?u=http://net/", "#?/", "?" + "k=v&" * 30_000]
    made = [f"{r.choice(['http', 'HTTPS', '', 'x'])}{r.choice(['://', '://', ':', ''])}{r.choice(hosts)}{r.choice(paths)}{r.choice(tails)}" for _ in range(400)]
    made += [None, None, "", "://", ":///", "http://net/"]
    rows = spark.createDataFrame(
        [(None if k % 50 == 0 else k % 300, u) for k, u in enumerate(made)], "page_id long, url string")
    out = urls.judge_urls(rows, RULES).collect()
    assert len(out) == len(made) and {r["verdict"] for r in out} <= {"allow", "block"}
    got = sorted(((r["host"], r["path"], r["rule"]) for r in out), key=repr)
    assert got == sorted((plain(u, RULES) for u in made), key=repr)
    assert all(r["verdict"] == RULES[r["rule"]] for r in out if r["rule"])


def test_lexical_features_against_plain_ones(spark):
    addresses = ["http://A.b.c/x/1?q=2&r=3;;s#t?u=1", "", None, "é://ö.net//", "a?b#c?d&e", "http://x/?&&"]
    rows = urls.with_rules(pages(spark, addresses).select("page_id", "url"), {})
    for r in urls.lexical(rows).collect():
        url, path, host = ((r[c] or "").encode() for c in ("url", "path", "host"))
        query = url.partition(b"#")[0].partition(b"?")[2]
        assert (r["url_length"], r["host_length"], r["path_length"]) == (len(url), len(host), len(path))
        assert (r["depth"], r["labels"]) == (path.count(b"/"), host.count(b".") + 1)
        assert r["digits"] == sum(48 <= c < 58 for c in url) / max(len(url), 1)
        assert r["parameters"] == len([x for x in re.split(b"[&;]", query) if x])
        p = [url.count(c) / len(url) for c in set(url)]
        assert abs(r["entropy"] + sum(x * math.log2(x) for x in p)) < 1e-9


def test_suffix_rates_leave_the_own_fold_out(spark):
    rows = [(f"http://h{k}.s{k % 4}.test/{k}", int(k % 4 == 0)) for k in range(200)]
    rows += [("http://only.once/", 1)] * 3
    frame = urls.with_rules(spark.createDataFrame(rows, "url string, label int"), {})
    model = urls.UrlModel(frame.select("url", "host", "path", "label"))
    learned = {r["url"]: r for r in model._features(frame.select("url", "host", "path", "label"), True).collect()}
    asked = {r["url"]: r for r in model._features(frame.select("url", "host", "path")).collect()}
    # Nobody else has this suffix: while learning it tells nothing, its own label least of all.
    assert learned["http://only.once/"]["suffix_2"] == model.rate
    assert asked["http://only.once/"]["suffix_2"] == (3 + 20 * model.rate) / 23
    fold = {r["url"]: r["f"] for r in frame.select("url", urls._fold().alias("f")).collect()}
    for url in ("http://h8.s0.test/8", "http://h9.s1.test/9"):
        same = [(u, v) for u, v in rows if u.split("/")[2].split(".", 1)[-1] == url.split("/")[2].split(".", 1)[-1]]
        rest = [v for u, v in same if fold[u] != fold[url]]
        assert abs(learned[url]["suffix_2"] - (sum(rest) + 20 * model.rate) / (len(rest) + 20)) < 1e-12
