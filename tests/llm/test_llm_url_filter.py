import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keydrift.llm import url_filter

SCHEMA = "page_id long, url string, html string"
TEXT = "<p>the river house stood by the green garden and the small town market</p><script>hidden casino</script>"
HOSTS = ["riverhouse.example.org", "greengarden.example.org", "www.townmarket.example.com", "garden-house.example.com"]
SPAM = ["casinohouse.example.org", "cheap-pills.example.com", "greencasino.example.com"]


def urls_of(hosts, n, lang="en"):
    return [f"https://{h}/{lang}/{k}.html" for h in hosts for k in range(n)]


def plain(rows):
    """The method in one process: counts, words, classes and scores of distinct URLs."""

    def names(text):
        return re.findall(r"[^\W\d_]+|\d+", text.lower())

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        return (m[1].lower(), m[2]) if m else ("", "")

    urls = sorted({u for _, u, _ in rows if u is not None})
    listed = {}
    counts = Counter()
    for u in urls:
        host, path = parts(u)
        found = set()
        for label in host.split("."):
            found |= {("host", n, len(names(label)) > 1) for n in names(label)}
        found |= {("path", n, True) for n in names(path)}
        listed[u] = {f[:2] for f in found}
        counts.update(n for _, n, apart in found if apart)
    for _, _, html in rows:
        text = re.sub(r"(?s)<(script|style)\b.*?</\1|<[^>]*>|&\w+;", " ", (html or "").lower())
        counts.update(re.findall(r"[^\W\d_]+", text))
    counts = Counter({w: n for w, n in counts.items() if len(w) <= url_filter.LONGEST_WORD})
    counts.update(dict.fromkeys(url_filter.UNWANTED, url_filter.KNOWN))
    total = sum(counts.values())

    def cost(word):
        return math.log(counts[word] / total) if word in counts else math.log(10 / total) - len(word) * math.log(10)

    def cut(name):
        if name.isdigit() or len(name) > url_filter.LONGEST:
            return [name]
        ways = [[]]  # every way to cut, for the short names of the test
        for k, c in enumerate(name):
            ways = [w for way in ways for w in ([*way, c], [*way[:-1], way[-1] + c] if way else None) if w] if k else [[c]]
        return max(ways, key=lambda way: sum(map(cost, way)))

    words = {n: cut(n) for u in urls for _, n in listed[u]}
    block = {u: any(w in url_filter.UNWANTED for _, n in listed[u] for w in words[n]) for u in urls}
    seen = {True: Counter(), False: Counter()}
    for u in urls:
        seen[block[u]].update((side, w) for side, n in listed[u] for w in words[n])
    kinds = set(seen[True]) | set(seen[False])
    size = {c: sum(seen[c].values()) + len(kinds) for c in seen}
    named = [u for u in urls if listed[u]]
    prior = math.log(sum(block[u] for u in named) / sum(not block[u] for u in named))
    weight = {k: math.log((seen[True][k] + 1) / size[True]) - math.log((seen[False][k] + 1) / size[False]) for k in kinds}
    return words, {u: prior + sum(weight[side, w] for side, n in listed[u] for w in words[n]) for u in urls}


def test_whole_method_against_one_process(spark):
    urls = urls_of(HOSTS, 3) + urls_of(SPAM, 2) + ["http://hotpills.example.org/fr/x", "http://riverhouse.example.org/de/Town-Häuser?q#f"]
    rows = [(k, u, TEXT if k % 2 else None) for k, u in enumerate(urls + urls[:2])]
    words, scores = plain(rows)
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r for r in url_filter.judged(pages).collect()}
    assert len(got) == len(rows)
    for k, u, _ in rows:
        assert got[k]["score"] == pytest.approx(scores[u], abs=1e-4), u
        if got[k]["rule"] is None:
            assert got[k]["verdict"] == ("block" if scores[u] > 0 else "allow")
    assert words["casinohouse"] == ["casino", "house"] and words["townmarket"] == ["town", "market"]
    verdicts = {rows[k][1].split("/")[2]: r["verdict"] for k, r in got.items() if r["rule"] is None}
    assert all(verdicts[h] == "block" for h in SPAM)
    assert all(verdicts[h] == "allow" for h in HOSTS)


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/"),
        "https://example.net/en": ("example.net", "/en", "net/"),
        "http://net/": ("net", "/", "net/"),
        "http://net": ("net", "", None),
        "http://planet/": ("planet", "/", None),
        "http://anexample.net/en/": ("anexample.net", "/en/", "net/"),
        "http://m.example.com/de/1#x": ("m.example.com", "/de/1", "example.com/de/"),
        "http://m.example.com/DE/1": ("m.example.com", "/DE/1", None),
        "ftp://x.org/fr/\n?a://b": ("x.org", "/fr/\n", "org/fr/"),
        "x.org/fr/": ("", "", None),
        "://?a/b": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://a.net#://x.org/fr/": ("a.net", "", None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select(
        "url", url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    got = df.select("url", "h", "p", url_filter.rule_of(F.col("h"), F.col("p"))["name"]).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == cases


def test_cutting_names():
    known = {"the": 50, "there": 5, "rein": 5, "in": 30, "casino": 9}
    assert url_filter.segmented("casinothe", known, 100) == ["casino", "the"]
    assert url_filter.segmented("zzthe", known, 100) == ["zz", "the"]
    assert url_filter.segmented("q", {}, 1) == ["q"]
    assert url_filter.segmented("a" * 64, {"a": 1}, 1) == ["a" * 64]


def test_defined_cases(spark):
    rows = [(1, None, None), (1, None, TEXT), (2, "no url", ""), (3, "http://" + "a" * 100_000 + ".org/" + "b/" * 1000, None), (None, "http://x.net/", "<")]
    pages = spark.createDataFrame([(*r, "h", 1.0) for r in rows], SCHEMA + ", host string, score double")
    got = url_filter.judged(pages).collect()
    assert sorted(str(r["verdict"]) for r in got) == ["allow"] * 4 + ["block"]
    assert len(got) == 5 and {r["rule"] for r in got} == {None, "net/"}
    assert url_filter.judged(pages.limit(0)).collect() == []
