import re
from collections import defaultdict

import pytest

from trailnet.llm import url_templates as ut


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :], re.S).group()


def ruled(host, path, rules=ut.RULES):
    fit = [(len(r), r, v) for v, r in rules for own, _, start in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + start)]
    return max(fit)[1:] if fit else (None, None)


def named(s):
    m = re.fullmatch(ut._ID.removesuffix(r"\z").removeprefix("^"), s)
    return "*" + (m.group(2) or "") if m else "\\" + s if s[0] in "*{\\" else s


def brute(pages, labels, depth=ut.DEPTH):
    marks = defaultdict(lambda: [0, 0])
    for d, q in labels:
        if d is not None and q in (0, 1):
            marks[d][q] += 1
    rows = [[p, *parse(u), [s for s in parse(u)[1].split("/") if s], "", *marks[p][::-1]] if p in marks else [p, *parse(u), [s for s in parse(u)[1].split("/") if s], "", 0, 0] for p, u in pages]
    for level in range(depth):
        nodes = defaultdict(lambda: defaultdict(list))
        for r in rows:
            if len(r[3]) > level:
                nodes[r[1], r[4]][named(r[3][level])].append(r)
        for children in nodes.values():
            n = sum(map(len, children.values()))
            own = {c: c if len(x) * ut.BRANCHES >= n and len(x) >= ut.LEAST_PAGES else "*" for c, x in children.items()}
            tally = defaultdict(lambda: [0, 0])
            for c, x in children.items():
                for r in x:
                    tally[own[c]][0] += r[5]
                    tally[own[c]][1] += r[6]
            g_all, b_all = (sum(v[k] for v in tally.values()) for k in (0, 1))
            apart = set()
            for b, (g, bad) in tally.items():
                cross = bad * (g_all - g) - (b_all - bad) * g
                if (g_all + b_all) * cross * cross > ut.DIFFERS * (g + bad) * (g_all + b_all - g - bad) * b_all * g_all:
                    apart.add(b)
            alike = sorted(set(tally) - apart)
            merged = alike[0] if len(alike) == 1 else "{" + "|".join(alike) + "}"
            for c, x in children.items():
                for r in x:
                    r[4] += "/" + (own[c] if own[c] in apart else merged)
    hosts, leaves = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for r in rows:
        if len(r[3]) > depth:
            r[4] += "/**"
        for t in (hosts[r[1]], leaves[r[1], r[4]]):
            t[0] += r[5]
            t[1] += r[6]
    g_all, b_all = sum(v[0] for v in hosts.values()), sum(v[1] for v in hosts.values())
    base = b_all / (g_all + b_all) if g_all + b_all else 0.0
    out = []
    for p, host, path, _, template, _, _ in rows:
        (hg, hb), (g, b) = hosts[host], leaves[host, template]
        share = (b + ut.STRENGTH * (hb + ut.STRENGTH * base) / (hb + hg + ut.STRENGTH)) / (b + g + ut.STRENGTH)
        rule, said = ruled(host, path)
        out.append((p, host, path, rule, said or ("block" if share > ut.REJECT else "allow"), template, g + b, round(share, 9)))
    return sorted(out, key=str)


def corpus():
    pages, labels = [], []
    for i in range(1500):
        host = "Hot.Example.org" if i % 3 == 0 else f"h{i % 9}.example.com"
        kind = ("en", "fr", "de", "cheap-pills", f"slug-{i}")[i % 5]
        pages.append((i, f"http{'s' * (i % 2)}://{host}/{kind}/{i}{'.html' if i % 4 == 0 else '/'}?q=/x#y"))
        labels.append((i, 0 if kind == "cheap-pills" else 1))
    odd = [None, "", "no scheme/en/1", "http://", "http://x", "http://X?a/b", "ftp://net/", "ftp://net", "a://b.NET/x", "http://Éa.example.net/en/1", "http://example.net/en/", "http://www.example.com/de/q", "http://zexample.com/de/", "u://v://w/x", "http://h/*/{a}/\\b", "http://h//a///b", "http://deep.org/" + "a/" * 40, "http://long.org/" + "x" * 20000, "http://org/fr/\n1", "http://h/0123456789abcdef.php#z"]
    pages += [(5000 + i, u) for i, u in enumerate(odd)] + [(None, "http://h/a"), (3, "http://h/a"), (3, "http://h/a")]
    return pages, labels + [(3, 0), (None, 0), (5, None), (7, 2), (5004, 0)]


def test_matches_brute_force(spark):
    pages, labels = corpus()
    df = spark.createDataFrame([(p, u, "h", 1) for p, u in pages], "page_id long, url string, host string, good int").repartition(4)
    got = ut.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "labels", "bad_share"]
    found = sorted(((*r[:7], round(r[7], 9)) for r in got.collect()), key=str)
    want = brute(pages, labels)
    assert found == want
    assert {(r[4], "cheap" in r[5]) for r in want if r[1] == "hot.example.org"} == {("block", True), ("allow", False)}


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_shallow_trees(spark, depth):
    pages, labels = [(i, f"http://h.org/a/b{i % 2}/c/d/{i}") for i in range(40)], [(i, i % 2) for i in range(40)]
    got = ut.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"), depth=depth)
    assert sorted(((*r[:7], round(r[7], 9)) for r in got.collect()), key=str) == brute(pages, labels, depth)


def test_empty_tables(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int")
    assert ut.judge(pages, labels).count() == 0
    (only,) = ut.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), labels).collect()
    assert (only.verdict, only.template, only.labels, only.bad_share) == ("allow", "/*", 0, 0.0)
