"""URL rules, and the path-template tree against one in plain Python, page by page."""

from collections import defaultdict

import numpy as np
import pytest
from plain_tree import add, grow, host_path, merge, rule_for, total

from strata.llm import queries
from strata.llm.url_filter import filter_urls

PARAMETERS = {"many": 8, "each": 3, "wide": 1000, "weight": 4.0, "reject": 0.9, "z": 2.0}


def plain(rows, rules, many, each, wide, weight, reject, z, main=0.05):
    """page id: (host, path, rule, verdict, purity)."""
    parsed = {i: (*host_path(u), *rule_for(*host_path(u), rules)) for i, u in rows}
    hosts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for host, path, _, said in parsed.values():
        segs = tuple(s for s in path.split("/") if s)
        hosts[host][segs] = add(hosts[host][segs], [1, said == "block", said == "allow"])
    b, a = (sum(n[k] for paths in hosts.values() for n in paths.values()) for k in (1, 2))
    base, purity = (b + 1) / (b + a + 2), {}
    for host, paths in hosts.items():
        labels = dict(grow(paths, many, each, wide))
        tree = {}
        for segs, way in labels.items():
            node = tree
            for x in way[:-1]:
                node = node.setdefault(x, {})
            node[""] = add(node.get("", [0, 0, 0]), paths[segs])
        merged, renamed = merge(tree, z, main)
        for segs, way in labels.items():
            q, node = base, merged
            for x in (None, *renamed(way)):
                node = node if x is None else node[x]
                _, nb, na = total(node)
                q = (nb + weight * q) / (nb + na + weight)
            purity[host, segs] = q
    out = {}
    for i, (host, path, rule, said) in parsed.items():
        q = purity[host, tuple(s for s in path.split("/") if s)]
        out[i] = (host, path, rule, said or ("block" if q >= reject else "allow"), q)
    return out


def urls_of(spark, sf_dir):
    return [(r.page_id, r.url) for r in queries.table(spark, sf_dir, "pages").select("page_id", "url").collect()]


def compare(found, rows, rules, **parameters):
    want = plain(rows, rules, **parameters)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.purity) for r in found.collect()}
    assert {i: v[:4] for i, v in got.items()} == {i: v[:4] for i, v in want.items()}
    assert [got[i][4] for i in sorted(got)] == pytest.approx([want[i][4] for i in sorted(got)], rel=1e-9)
    return got


def test_table_against_the_plain_tree(spark):
    sf = "/root/testdata/sf0.01"
    got = compare(queries.op10_url_filter(spark, sf), urls_of(spark, sf), queries.URL_RULES, **PARAMETERS)
    free = [v for v in got.values() if v[2] is None]
    assert {v[3] for v in free} == {"allow", "block"} and len({v[4] for v in free}) > 3


def test_random_trees_against_the_plain_one(spark):
    """Hosts with variable segments, branches of one form and of others, deep and shared paths, labels by rules."""
    rng = np.random.default_rng(8)
    rows, rules = [], [("block", "h0.org", "/bad/"), ("allow", "h0.org", "/good/"), ("block", "h1.org", "/u/1"), ("allow", "h2.org", "/")]
    for i in range(700):
        host = f"h{rng.integers(0, 4)}.org"
        kind = rng.integers(0, 7)
        path = [f"/bad/{rng.integers(0, 90)}", f"/good/{rng.integers(0, 9)}/x", f"/u/{rng.integers(0, 150)}/p/{rng.integers(0, 3)}", "/a/" + "/".join("bcd"[: rng.integers(1, 4)]), f"/news/{rng.integers(0, 5)}/{rng.integers(0, 40)}", f"/{rng.integers(0, 30)}", ""][kind]
        rows.append((i, f"http://{host}{path}" + ("?q" if i % 9 == 0 else "")))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for parameters in (PARAMETERS, PARAMETERS | {"many": 4, "wide": 20, "z": 1.0, "reject": 0.7}):
        compare(filter_urls(pages, rules, **parameters), rows, rules, **parameters)


def test_labels_reach_branches_of_the_same_form(spark):
    """Of a host's language branches two are ruled bad; the third, alike in all else, is blocked, a different one isn't."""
    rows = [(i, f"http://a.net/{'es fr en'.split()[i % 3]}/{i}") for i in range(120)] + [(200 + i, f"http://b.com/en/{i}") for i in range(60)]
    rows += [(300 + i, f"http://c.net/{'es' if i < 20 else 'shop'}/{i}" + ("" if i < 20 else "/buy")) for i in range(40)] + [(400 + i, f"http://d.org/x/{i}") for i in range(10)]
    got = compare(filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES), rows, queries.URL_RULES, **PARAMETERS)
    assert {got[i][3] for i, u in rows if "a.net/en" in u} == {"block"}
    assert {got[i][3] for i, u in rows if "d.org" in u} == {"allow"}
    purity = {u.split("/")[3]: got[i][4] for i, u in rows if "c.net" in u}
    assert purity["shop"] < purity["es"]


def test_rules_and_awkward_urls(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x", "http://example.com/en/x?q#f", "http://a.b.net/es/1", "http://notnet/es/1", "https://x.net/esx/1", "http://c.com", "a://b://c/d", "http://h.org/\n/é?x", "http://h.org/*//", 'http://h.org/"\\/{n}', "http://deep.org/" + "/".join(["a"] * 14), "http://deep.org/" + "/".join(["a"] * 5) + "/b", "http://h.org/" + "x" * 100_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(99, urls[3])]
    names = "host path segments labels merged label parent child n blocked allowed name form template purity found said id at alone variable"
    pages = spark.createDataFrame([(*r, *names.split()) for r in rows], "page_id long, url string, " + ", ".join(f"{c} string" for c in names.split()))
    found = filter_urls(pages, queries.URL_RULES)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"] and found.count() == len(rows)
    got = compare(found, rows, queries.URL_RULES, **PARAMETERS)
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3][:4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[4][:4] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[5][:4] == ("a.b.net", "/es/1", "net/es/", "block")
    assert [got[k][:3] for k in (6, 7, 8, 9)] == [("notnet", "/es/1", None), ("x.net", "/esx/1", None), ("c.com", "", None), ("b:", "//c/d", None)]
    assert got[10][:2] == ("h.org", "/\n/é")
    assert filter_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_long_shared_paths_take_few_rounds(spark):
    """Two paths that share a thousand segments, and two that part early: one round for each parting."""
    import time

    long = "/".join(f"s{i}" for i in range(1000))
    urls = [f"http://a.com/{long}/x/1", f"http://a.com/{long}/y/2", f"http://a.com/{long}", "http://b.com/p/q/r", "http://b.com/p/q/t"]
    began = time.perf_counter()
    got = {r.page_id: (r.template, r.verdict) for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), []).collect()}
    assert time.perf_counter() - began < 90
    assert [got[i][0] for i in range(5)] == [f"/{long}/*", f"/{long}/*", f"/{long}", "/p/q/*", "/p/q/*"]  # like leaves are merged
