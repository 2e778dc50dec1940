"""URL verdicts against plain Python and SQL."""

import random
import re
from collections import defaultdict

import duckdb

from talkloom.llm import url_filter as urls


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def shapes(path):
    if not path:
        return ()
    s = [re.sub("[0-9]+", "{n}", re.sub("^[0-9a-fA-F-]{16,}$", "{h}", x)) for x in path[1:].split("/")]
    return tuple(s if len(s) <= urls.DEPTH else [*s[: urls.DEPTH - 1], "**"])


def plain(rows, bad):
    """rows: (key, url); bad: {key: 0 or 1}.  {(key, url): (host, path, rule, verdict, template, purity)}, a tree of dictionaries."""
    at = {}
    leaves = defaultdict(lambda: [0, 0, 0])
    for key, url in rows:
        host, path = parts(url)
        at[key, url] = (host, path, shapes(path))
        x = leaves[host, shapes(path)]
        x[0] += 1
        if key in bad:
            x[1] += 1
            x[2] += bad[key]
    lab, low = sum(x[1] for x in leaves.values()), sum(x[2] for x in leaves.values())
    done = {}

    def grow(host, members, template, purity, d):
        kids = defaultdict(list)
        for s in members:
            if len(s) < d:
                done[host, s] = (template, purity)
            else:
                kids[s[d - 1]].append(s)
        sums = {k: [sum(leaves[host, s][i] for s in v) for i in range(3)] for k, v in kids.items()}
        n, all_, bad_ = (sum(x[i] for x in sums.values()) for i in range(3))
        rate, branches = (bad_ + 1.0) / (all_ + 2.0), defaultdict(list)
        for k, (m, c, b) in sums.items():
            off = b - c * rate
            name = "*" if len(kids) >= urls.MANY and m * urls.MANY < n else "~" if off * off <= urls.Z**2 * c * rate * (1.0 - rate) else k
            branches[name].append(k)
        for name, ks in branches.items():
            c, b = (sum(sums[k][i] for k in ks) for i in (1, 2))
            grow(host, [s for k in ks for s in kids[k]], f"{template}/{name}", (b + urls.PRIOR * purity) / (c + urls.PRIOR), d + 1)

    start = (low + 1.0) / (lab + 2.0)
    for host in {h for h, _ in leaves}:
        own = [s for h, s in leaves if h == host]
        c, b = (sum(leaves[host, s][i] for s in own) for i in (1, 2))
        grow(host, own, "", (b + urls.PRIOR * start) / (c + urls.PRIOR), 1)
    out = {}
    for k, (host, path, s) in at.items():
        template, purity = done[host, s]
        r, v = rule(host, path)
        out[k] = (host, path, r, v or ("block" if purity > urls.CUT else "allow"), host + template, round(purity, 6))
    return out


ODD = [None, "", "no scheme", "://", "x://", "HTTP://WWW.Example.COM/en/1", "http://net/es/", "http://a.net?x=/es/", "http://a.net/es/x?y", "http://a.net#/fr/", "http://ÄB.net/fr/1", "http://com", "http://com/", "http://notcom/x",
       "http://example.com/en", "http://m.example.com/en/", "http://www.example.com/en/a", "http://b.www.example.com/en/a", "http://h.org//a///", "http://h.org/" + "a/" * 30, "http://h.org/0123456789abcdef0123/x", "a://b://c/d", "http://h.org/a\nb/c?d",
       "http://u@h.org:80/p", "http://h.org/" + "z" * 20000]


def planted(seed, n=3000):
    """A hot host, bad sections, variable names, and hosts of few urls."""
    rng = random.Random(seed)
    rows, bad = [], {}
    for i in range(n):
        host = "hot.org" if rng.random() < 0.4 else f"h{rng.randrange(30)}.org"
        section = rng.choice(["news", "spam", "user", "shop"])
        path = {"news": f"/news/{rng.randrange(9)}/{i}", "spam": f"/spam/{rng.choice(['pills', 'bets'])}/{i}.html", "user": f"/user/name{'abcdefgh'[i % 8]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/", "shop": f"/shop/{rng.choice('abc')}"}[section]
        rows.append((i, f"http://{host}{path}"))
        if rng.random() < 0.5:
            bad[i] = int(rng.random() < (0.95 if section == "spam" else 0.05))
    return rows + [(n + i, u) for i, u in enumerate(ODD)] + rows[:5] + [(None, "http://hot.org/spam/pills/1.html")], bad


def test_by_plain_tree(spark):
    rows, bad = planted(1)
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, host string, purity int")
    labels = spark.createDataFrame([*bad.items(), (n := len(rows) + 9, None), (n + 1, 1)], "page_id long, bad int")
    got = urls.judge_urls(pages, labels)
    have = sorted(((r["page_id"], *tuple(r)[1:]) for r in got.collect()), key=str)
    raw = plain(rows, bad)
    assert have == sorted(((k, *raw[k, u]) for k, u in rows), key=str)
    spam = [v for (k, u), (_, _, r, v, *_) in raw.items() if u and "hot.org/spam" in u]
    news = [v for (k, u), (_, _, r, v, *_) in raw.items() if u and "hot.org/news" in u]
    assert set(spam) == {"block"} and set(news) == {"allow"}
    assert any("/*" in x[4] for x in raw.values()) and any("/~" in x[4] for x in raw.values())


def test_no_rows_no_labels(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), none).count() == 0
    rows = [(i, u) for i, u in enumerate(ODD)]
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), none).collect()}
    raw = plain(rows, {})
    assert got == {k: raw[k, u] for k, u in rows}


def test_query_by_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = urls.op12_url_filters(spark, sf)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(urls.OP12_SQL).fetchall())
