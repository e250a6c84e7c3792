"""The URL filter: rules, templates and verdicts against plain Python and SQL."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from shipfold.llm import url_filter as U


def _parse(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def _rule(host, path):
    fits = [(len(r), r, v) for v, r in U.RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def _expected(urls, labels=None):
    """Plain recursion over each host's tree; returns a list of result tuples."""
    rows = []
    for k, url in enumerate(urls):
        host, path = _parse(url)
        rule, verdict = _rule(host, path)
        segs = ["*" if any(c in "0123456789" for c in s) else "=" + s for s in path.split("/") if s]
        label = (None if verdict is None else verdict == "block") if labels is None else labels[k]
        rows.append({"host": host, "path": path, "rule": rule, "ruled": verdict, "segs": segs, "label": label, "node": ""})
    for level in range(U.DEPTH):
        nodes = defaultdict(list)
        for r in rows:
            if len(r["segs"]) > level:
                nodes[r["host"], r["node"]].append(r)
        for (_, node), here in nodes.items():
            has = Counter(r["segs"][level] for r in here)
            branches = defaultdict(list)
            for r in here:
                s = r["segs"][level]
                keep = s != "*" and has[s] >= U.MIN_SUPPORT and has[s] * U.LITERALS >= len(here)
                branches[s if keep else "*"].append(r)

            def after(r):
                return r["segs"][level + 1] if len(r["segs"]) > level + 1 else None

            def shares(rs):
                last = level + 1 == U.DEPTH
                return tuple(sum(f(r) for r in rs) / len(rs) for f in (
                    lambda r: r["label"] is True, lambda r: r["label"] is False, lambda r: after(r) is None,
                    lambda r: (after(r) is not None) if last else after(r) == "*"))

            order = sorted((shares(rs), t) for t, rs in branches.items())
            classes = []
            for share, token in order:
                if classes:
                    before, last = classes[-1][-1]
                    wide = U.HOEFFDING * (1 / math.sqrt(len(branches[token])) + 1 / math.sqrt(len(branches[last])))
                    if all(abs(a - b) <= wide for a, b in zip(share, before, strict=True)):
                        classes[-1].append((share, token))
                        continue
                classes.append([(share, token)])
            for c in classes:
                for _, token in c:
                    for r in branches[token]:
                        r["node"] = node + "/" + min(t for _, t in c)
    counts = defaultdict(lambda: [0, 0])
    for r in rows:
        r["node"] += "/**" if len(r["segs"]) > U.DEPTH else ""
        if r["label"] is not None:
            counts[r["host"], r["node"]][r["label"]] += 1
    out = []
    for r in rows:
        good, bad = counts[r["host"], r["node"]]
        purity = (bad + 1) / (bad + good + 2)
        verdict = r["ruled"] or ("block" if purity >= U.REJECT else "allow")
        out.append((r["host"], r["path"], r["rule"], verdict, r["node"], purity))
    return out


URLS = [
    None, "", "no scheme/a/b", "http://", "http://x.net", "http://x.net?q=/es/", "http://x.net#/es/1", "HTTP://WWW.Example.COM/en/1?x=1",
    "http://example.com/en/1", "http://a.example.com/en/", "http://a.example.com/en", "http://xcom/en/1", "ftp://com/", "http://com",
    "http://net/es/1", "http://a.net/es/", "http://a.net/es", "http://user@x.net:80/fr/2", "http://É.net/ÉÀ/1", "http://x.net//es//1//",
    "http://x.net/a/b/c/d/e/f/g", "http://x.net/=/*/**", "http://x.org/" + "s/" * 3000, "http://x.org/" + "long" * 5000, "a://b://c/d",
    "http://x.net/es/\n1", "http://x.net/es/1", "http://x.net/es/1",
]


def _frame(spark, urls):
    rows = [(k if k % 9 else None, u, "x", "y") for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, shape string").repartition(3)


def _many():
    urls = list(URLS)
    for k in range(400):  # a hot host with branches of all kinds
        urls += [f"http://hot.net/{'es' if k % 3 else 'en'}/{k}", f"http://hot.net/tag{'' if k % 2 else '/x'}/{k}",
                 f"http://hot.net/blog/{'abcdefgh'[k % 8]}/page", f"http://hot.org/u/{'qwertyuiop'[k % 10]}{'asdfghjkl'[k % 9]}/{k}"]
    return urls + [f"http://s{k % 50}.net/{('es', 'en', 'de', 'fr')[k % 4]}/p{k}" for k in range(300)]


def test_filter_matches_plain_python(spark):
    urls = _many()
    got = U.filter_urls(_frame(spark, urls))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    want = Counter((k if k % 9 else None, *r) for k, r in enumerate(_expected(urls)))
    assert Counter(map(tuple, got.collect())) == want
    assert U.filter_urls(_frame(spark, urls).limit(0)).count() == 0


def test_labels_of_the_caller_reject_a_template_and_leave_others(spark):
    urls = [f"http://a.org/{'calendar' if k % 2 else 'news'}/{k}" for k in range(400)] + ["http://a.org/calendar/next"]
    labels = [(k % 2 == 1) if k % 5 == 0 else None for k in range(400)] + [None]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(zip(urls, labels, strict=True))],
                               "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in U.filter_urls(df, label=df["bad"]).collect()}
    assert [got[k].verdict for k in range(400)] == ["block" if k % 2 else "allow" for k in range(400)]
    assert got[400].verdict == "block" and got[400].rule is None and got[400].template == "/=calendar/*"
    want = _expected(urls, labels)
    assert [tuple(got[k])[1:] for k in range(401)] == want


def test_alike_branches_share_a_template_and_unlike_ones_do_not(spark):
    urls = [f"http://a.org/{s}/{k}" for k in range(200) for s in ("red", "green")] + [f"http://a.org/blue/x/{k}" for k in range(200)]
    got = {r.path.split("/")[1]: r.template for r in U.filter_urls(_frame(spark, urls)).collect()}
    assert got["red"] == got["green"] != got["blue"]


def test_too_many_rules_are_refused():
    with pytest.raises(ValueError):
        U.by_rules(None, None, [("allow", f"h{k}/") for k in range(U.MAX_RULES + 1)])


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    want = Counter(con.sql(f"SELECT {', '.join(names)} FROM ({U.oracle()})").fetchall())
    assert Counter(map(tuple, U.filter_urls(pages).collect())) == want
    con.register("odd", _frame(spark, _many()).toPandas())
    con.sql("CREATE OR REPLACE VIEW pages AS SELECT * FROM odd")
    got = Counter(tuple(r)[1:] for r in U.filter_urls(_frame(spark, _many())).collect())
    assert got == Counter(r[1:] for r in con.sql(f"SELECT {', '.join(names)} FROM ({U.oracle()})").fetchall())
