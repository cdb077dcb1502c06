from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import urltree
from tidewater.llm.queries import URL_RULES

SPLITS = [
    ("http://A.Example.COM/en/12?x=1#y", "a.example.com", "/en/12"),
    ("https://x.org", "x.org", ""),
    ("https://x.org?p=/a", "x.org", ""),
    ("ftp://U@H:80/A/B/#f?g", "u@h:80", "/A/B/"),
    ("a://b://c/d", "b:", "//c/d"),
    ("://h/p", "h", "/p"),
    ("http:///p", "", "/p"),
    ("http://É.com/é\n?z", "É.com", "/é\n"),
    ("no scheme/at all", "", ""),
    ("", "", ""),
    (None, "", ""),
]


def test_hosts_and_paths(spark):
    rows = spark.createDataFrame([(u,) for u, _, _ in SPLITS], "url string")
    host, path = urltree.host_and_path(F.col("url"))
    assert [tuple(r) for r in rows.select("url", host, path).collect()] == SPLITS


RULED = [
    ("org", "/x", "org/"), ("a.org", "/", "org/"), ("a.org", "", None), ("aorg", "/x", None), ("example.org", "/es/1", "example.org/es/"),
    ("m.example.org", "/en/12", "example.org/en/1"), ("m.example.org", "/en/2", "org/"), ("x.com", "/fr/", "com/fr/"),
    ("x.com", "/fr", None), ("x.com", "/de/9", "com/de/"), ("", "", None), ("myexample.org", "/es/", "org/"),
]


def test_longest_rule_wins(spark):
    rows = spark.createDataFrame(RULED, "host string, path string, want string")
    found = urltree.matched_rule(F.col("host"), F.col("path"), URL_RULES)
    assert all(r.want == r.got for r in rows.select("want", found["text"].alias("got")).collect())
    assert rows.select(urltree.matched_rule(F.col("host"), F.col("path"), ()).alias("r")).where("r IS NOT NULL").count() == 0


def shaped(path, depth):
    if path == "":
        return ()
    parts = (path[1:] if path.startswith("/") else path).split("/")
    parts = parts[:depth] + (["**"] if len(parts) > depth else [])
    out = []
    for p in parts:
        stem, tail = re.fullmatch(r"(?s)(.*?)((?:\.[A-Za-z][A-Za-z0-9]{0,5})?)", p).groups()
        mark = next((m for x, m in urltree.SHAPES if re.search(x, stem)), None)
        out.append(mark + tail if mark else p)
    return tuple(out)


def plain_tree(urls, tree):
    """``{(host, shaped): (merged, labels, bad_rate)}`` of (host, path, bad) rows."""
    rows = defaultdict(lambda: [0, 0, 0])
    for host, path, bad in urls:
        r = rows[host, shaped(path, tree.depth)]
        r[0] += 1
        r[1] += bad is not None
        r[2] += bad or 0
    template = {k: () for k in rows}
    for level in range(tree.depth):
        kids, known, parents = Counter(), Counter(), defaultdict(set)
        for k, r in rows.items():
            if len(k[1]) > level:
                kids[k[0], template[k], k[1][level]] += r[0]
                parents[k[0], template[k]].add(k[1][level])
                known[k[0], template[k], k[1][level]] += r[1]
        new = {}
        for k in rows:
            new[k] = template[k]
            if len(k[1]) > level:
                p, c = (k[0], template[k]), k[1][level]
                n = kids[(*p, c)]
                keep = len(parents[p]) <= tree.fanout or n >= tree.support or known[(*p, c)] >= tree.min_labels or c.startswith("<") or c == "**"
                new[k] += (c if keep else "*",)
        template = new
    template = {k: t + (("**",) if len(k[1]) > tree.depth else ()) for k, t in template.items()}
    merged = {(k[0], t): t for k, t in template.items()}
    sums = defaultdict(lambda: [0, 0])
    for k, r in rows.items():
        sums[k[0], template[k]][0] += r[1]
        sums[k[0], template[k]][1] += r[2]
    for at in range(tree.depth, 0, -1):
        branch = defaultdict(lambda: [0, 0])
        for (h, t), m in merged.items():
            branch[h, m][0] += sums[h, t][0]
            branch[h, m][1] += sums[h, t][1]
        pools = defaultdict(list)
        for h, m in branch:
            if len(m) >= at:
                pools[h, m[: at - 1] + ("~",) + m[at:]].append(m)
        into = {}
        for (h, masked), members in pools.items():
            pl, pb = (sum(branch[h, m][i] for m in members) for i in (0, 1))
            for m in members:
                labels, bad = branch[h, m]
                alike = not labels or (bad / labels - pb / pl) ** 2 <= tree.z**2 * (pb / pl) * (1 - pb / pl) / labels
                if len(members) > 1 and alike:
                    into[h, m] = masked
        merged = {(h, t): into.get((h, m), m) for (h, t), m in merged.items()}
    all_l, all_b = (sum(s[i] for s in sums.values()) for i in (0, 1))
    base = all_b / all_l if all_l else 0.0
    host, final = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, t), s in sums.items():
        for i in (0, 1):
            host[h][i] += s[i]
            final[h, merged[h, t]][i] += s[i]
    out = {}
    for k in rows:
        m = merged[k[0], template[k]]
        labels, bad = final[k[0], m]
        prior = (host[k[0]][1] + tree.prior * base) / (host[k[0]][0] + tree.prior)
        out[k] = m, labels, (bad + tree.prior * prior) / (labels + tree.prior)
    return out


@pytest.mark.parametrize("depth", [6, 2])
def test_tree_matches_plain_version(spark, depth):
    random.seed(4)
    tree = urltree.Tree(depth=depth, fanout=5, support=4)
    urls = []
    for k in range(900):
        host = random.choice(["a.com", "a.com", "a.com", "b.org", "c.net"])
        kind = random.choice(["blog", "shop", "spam", "t"])
        tail = {"blog": f"{random.choice('pqr')}-slug-{random.randrange(300)}", "shop": f"{random.randrange(999)}.html"}.get(kind, f"2024-0{k % 9 + 1}")
        path = f"/{random.choice(['en', 'de', 'fr'])}/{kind}/{tail}" + random.choice(["", "", "/", "/deep/er/still/more/and/on"])
        bad = None if random.random() < 0.4 else int(random.random() < (0.9 if kind == "spam" else 0.1))
        urls.append((k, f"https://{host}{path}?q={k}", bad))
    urls += [(1000, None, None), (1001, None, 1), (1002, "nothing", 0), (1003, "http://solo.org", None), (3, urls[3][1], 1), (None, urls[4][1], 0)]
    df = spark.createDataFrame(urls, "id long, url string, bad int").repartition(5)
    host, path = urltree.host_and_path(F.col("url"))
    parts = [(r.h, r.p, r.bad) for r in df.select(host.alias("h"), path.alias("p"), "bad").collect()]
    want = plain_tree(parts, tree)
    rows = urltree.judged_urls(df, (), tree).collect()
    assert len(rows) == len(urls)
    for r in rows:
        merged, labels, rate = want[r.host, shaped(r.path, depth)]
        assert r.template == "/" + "/".join(merged) and r.n_labels == labels and abs(r.bad_rate - rate) < 1e-8
        assert r.verdict == ("block" if rate >= tree.max_bad and labels >= tree.min_labels else "allow")
    assert {r.verdict for r in rows} == {"allow", "block"}
    ruled = urltree.judged_urls(df, [urltree.Rule("block", "org", "/"), urltree.Rule("allow", "b.org", "/en/spam")], tree).collect()
    assert all(r.verdict == {"org/": "block", "b.org/en/spam": "allow"}.get(r.rule, r.verdict) for r in ruled)


def test_a_bad_section_among_many_equal_ones_is_blocked(spark):
    """60 sections of a host, each a small share of it: the one whose labels are all bad does not hide among them."""
    urls = [(s * 100 + k, f"http://host.com/sec{chr(97 + s // 26)}{chr(97 + s % 26)}/page-{k}", int(s == 31) if k < 40 else None) for s in range(60) for k in range(60)]
    rows = urltree.judged_urls(spark.createDataFrame(urls, "id long, url string, bad int")).collect()
    assert {r.id // 100 for r in rows if r.verdict == "block"} == {31} and sum(r.verdict == "block" for r in rows) == 60


def test_no_rows_no_labels(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", None)], "id long, url string, bad int")
    assert [r.verdict for r in urltree.judged_urls(df).collect()] == ["allow"]
    assert urltree.judged_urls(df.limit(0)).count() == 0


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/en/7.html?x"), (2, "http://a/en/8/"), (3, "http://a/9/en"), (4, None), (5, "http://a/en/10")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (8, 1, 0), (10, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.id: r.bad for r in urltree.page_labels(pages, labels).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None, 5: 1}
