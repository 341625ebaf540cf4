from ledgerlens.llm import urls
from tests.llm.helpers import SMALL


def test_parse_and_rules(spark):
    cases = [("https://WWW.Example.com/en/1?x=/a#b", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
             ("http://blog.example.com/en/7#top", "blog.example.com", "/en/7", "example.com/en/", "block"),
             ("http://example.com/en", "example.com", "/en", "com/", "allow"),
             ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
             ("ftp://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
             ("http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
             ("http://a.com", "a.com", "", None, None), ("http://a.com?/en/", "a.com", "", None, None),
             ("http:///en/", "", "/en/", None, None), ("no scheme/en/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
             ("a://b://c.com/d", "b:", "//c.com/d", None, None), ("http://a.com:80/en/", "a.com:80", "/en/", None, None),
             ("http://É.COM/ÉN/\nx", "É.com", "/ÉN/\nx", "com/", "allow")]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    out = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == (verdict or "allow")


def test_templates_generalise_and_judge(spark):
    rows, labels = [], []
    for i in range(60):
        rows += [(i, f"http://h.org/news/{i}.html"), (100 + i, f"http://h.org/news/story-{'abcdefghij'[i % 10] * (i + 1)}"),
                 (200 + i, f"http://h.org/spam/offer{i}"), (300 + i, f"http://bad.org/x/{i}")]
        labels += [(i, 0), (100 + i, 0), (200 + i, 1)] if i % 2 else [(300 + i, 1)]
    rows += [(500, "http://new.org/a"), (501, "http://bad.org/never/seen"), (0, "http://h.org/news/0.html")]
    out = {}
    for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect():
        out[r.page_id] = r
    assert out[200].verdict == "block" and out[0].verdict == "allow" and out[150].verdict == "allow"
    assert out[200].template == "/spam/offer0" and out[300].verdict == "block" and out[501].verdict == "block"
    assert out[500].verdict == "allow"
    assert len({out[100 + i].template for i in range(60)}) == 1      # many children: one wildcard


def name_of(i):
    """A name without digits for each number."""
    return "u" + "".join("abcdefghij"[int(c)] for c in str(i))


def test_hot_child_of_a_variable_branch_keeps_its_branch(spark):
    rows = [(i, f"http://h.org/{name_of(i % 700)}/x{name_of(i)}") for i in range(2000)]
    rows += [(10_000 + i, f"http://h.org/spam/{name_of(i)}") for i in range(1000)]
    labels = [(p, int(p >= 10_000)) for p, _ in rows]
    out = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()}
    assert {out[p].verdict for p, _ in rows if p >= 10_000} == {"block"}
    assert {out[p].verdict for p, _ in rows if p < 10_000} == {"allow"}
    assert out[10_000].template.startswith("/spam/") and len({out[i].template.split("/")[1] for i in range(2000)}) == 1


def test_few_labels_do_not_make_a_branch_below_a_variable_one(spark):
    rows = [(i, f"http://h.org/{name_of(i)}") for i in range(200)]
    labels = [(i, int(i % 10 == 0)) for i in range(200)]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()
    assert {r.template for r in out} == {"/*"} and {r.verdict for r in out} == {"allow"}


def test_deep_subtrees_are_told_apart(spark):
    for above in ("a/b/c/d", "a/b/c/d/e/f/g"):
        rows = [(i, f"http://h.org/{above}/ok/{name_of(i)}") for i in range(200)]
        rows += [(1000 + i, f"http://h.org/{above}/spam/{name_of(i)}") for i in range(100)]
        rows += [(5000, f"http://h.org/{above}/spam/never/{'/'.join(map(name_of, range(300)))}"), (5001, "http://h.org/"), (5002, "http://h.org/a")]
        labels = [(p, int(p >= 1000)) for p, _ in rows if p < 5000]
        out = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()}
        assert len(out) == len(rows)
        assert {out[p].verdict for p, _ in rows if p < 1000} == {"allow"} and {out[p].verdict for p, _ in rows if 1000 <= p < 5000} == {"block"}
        assert out[1000].template == f"/{above}/spam/*" and out[0].template == f"/{above}/ok/*"
        assert out[5000].template.startswith(f"/{above}/spam/") and out[5000].template.endswith(name_of(299))
        assert out[5001].template == "/" and out[5002].template == "/a"


def plain(rows, labels, reject=0.5):
    """Template and share of each page, segment by segment, without Spark."""
    import math
    import re
    bad_of = {}
    for p, b in labels:
        if p is not None and b is not None:
            bad_of[p] = max(b, bad_of.get(p, b))
    paths = {}
    for p, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        parts = tuple(x for x in re.sub("[0-9]+", "0", re.match(r"[^/?#]*([^?#]*)", rest)[1]).split("/") if x)
        own = paths.setdefault((host.lower(), parts), [0, 0, 0, []])
        own[0] += 1
        own[1] += p in bad_of
        own[2] += bad_of.get(p, 0)
        own[3].append(p)
    template = {key: () for key in paths}
    for level in range(max((len(k[1]) for k in paths), default=0)):
        points = {}
        for key in paths:
            if len(key[1]) > level:
                points.setdefault((key[0], template[key]), {}).setdefault(key[1][level], []).append(key)
        for children in points.values():
            total = [sum(paths[k][i] for ks in children.values() for k in ks) for i in range(3)]
            many = len(children) >= 8 and len(children) >= 0.2 * total[0]
            for child, keys in children.items():
                known, bad = (sum(paths[k][i] for k in keys) for i in (1, 2))
                others, others_bad = total[1] - known, total[2] - bad
                keep = len(children) == 1
                if known and others and 0 < total[2] < total[1]:
                    pooled = total[2] / total[1]
                    apart = abs(bad / known - others_bad / others) - (many and (1 / known + 1 / others) / 2)
                    keep = keep or apart / math.sqrt(pooled * (1 - pooled) * (1 / known + 1 / others)) >= 1.96
                for k in keys:
                    template[k] += (child if keep else "*",)
    sums = lambda of: {g: [sum(paths[k][i] for k in paths if of(k) == g) for i in (1, 2)] for g in map(of, paths)}
    leaf, host = sums(lambda k: (k[0], template[k])), sums(lambda k: k[0])
    known, bad = (sum(h[i] for h in host.values()) for i in (0, 1))
    overall = bad / known if known else 0.0
    out = {}
    for key, (*_, pages) in paths.items():
        k, b = leaf[key[0], template[key]]
        above = (host[key[0]][1] + 5 * overall) / (host[key[0]][0] + 5)
        out.update({p: ("/" + "/".join(template[key]), (b + 5 * above) / (k + 5)) for p in pages})
    return out


def test_equals_brute_force(spark):
    import random
    r = random.Random(11)
    words, rows, labels = ["news", "spam", "shop", "a1", "b"], [], []
    for i in range(1500):
        host = r.choice(["one.org", "two.org", "three.org"])
        parts = [r.choice(words) for _ in range(r.randrange(0, 5))] + r.choice([[], [name_of(i)], [name_of(i % 40)], [f"{i}.html"], ["x", "y", "z", name_of(i % 7)]])
        rows.append((i, f"http://{host}/{'/'.join(parts)}"))
        if r.random() < 0.6:
            labels.append((i, int(r.random() < (0.9 if "spam" in parts[:3] else 0.1))))
    rows += [(2000, None), (2001, "http://one.org"), (2002, "http://four.org/p/q/r")] + rows[:5]
    want = plain(rows, labels)
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.template == want[x.page_id][0] and abs(x.bad_share - want[x.page_id][1]) < 1e-9
        assert x.verdict == ("block" if x.bad_share > 0.5 else "allow")


def test_shared_segments_are_one_edge(spark, monkeypatch):
    """A crawler trap of equal segments takes no more rounds than its branch points."""
    trap = "/".join(["again"] * 1000)
    rows = [(i, f"http://h.org/{trap}/{name_of(i)}/{trap}/end") for i in range(20)] + [(99, f"http://h.org/{trap}")]
    written = []
    monkeypatch.setattr(urls, "shared_folder", lambda spark, name, make=urls.shared_folder: written.append(make(spark, name)) or written[-1])
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int"), rules=()).collect()
    assert {r.template for r in out} == {f"/{trap}/*/{trap}/end", f"/{trap}"}
    import os
    assert len([f for f in os.listdir(written[0].removeprefix("file:")) if not f.startswith(".")]) <= 4


def test_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = urls.op8_url_filter(spark, SMALL)
    assert out.count() == pages.count() and {r.verdict for r in out.collect()} <= {"allow", "block"}


def test_no_python_in_the_plan(spark):
    plan = urls.op8_url_filter(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(None, None), (1, None), (1, 1), (1, 0)], "page_id long, bad int")
    assert urls.filter_urls(pages, labels).count() == 0
