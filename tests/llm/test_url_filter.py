import collections
import math
import random

import pytest
from evoselect.llm.url_filter import BEGIN, END, filter_urls, fit_models, score_texts


def plain_model(texts, order):
    n, follow = collections.Counter(), collections.defaultdict(set)
    for t, times in texts:
        s = BEGIN * order + t + END
        for i in range(order, len(s)):
            for k in range(order + 1):
                n[s[i - k:i], s[i]] += times
                follow[s[i - k:i]].add(s[i])
    total = collections.Counter()
    for (c, _), x in n.items():
        total[c] += x

    def logp(t):
        s, out = BEGIN * order + t + END, []
        for i in range(order, len(s)):
            p = 1 / 256
            for k in range(order + 1):
                c = s[i - k:i]
                if total[c]:
                    p = (n[c, s[i]] + len(follow[c]) * p) / (total[c] + len(follow[c]))
            out.append(math.log(p))
        return sum(out) / len(out)
    return logp


@pytest.mark.parametrize("heavy", [1, 10, 10**6])   # no gram is heavy, some, all
def test_ratio_equals_plain_models(spark, heavy):
    rng = random.Random(1)
    texts = [("".join(rng.choice("ab/c") for _ in range(rng.randint(0, 12))), rng.randrange(3), rng.randrange(3))
             for _ in range(40)]
    texts = [(t, g, b) for t, (g, b) in {t: (g, b) for t, g, b in texts}.items() if g or b]
    df = spark.createDataFrame(texts, "text string, good long, bad long")
    good = plain_model([(t, g) for t, g, _ in texts if g], 3)
    bad = plain_model([(t, b) for t, _, b in texts if b], 3)
    asked = spark.createDataFrame([("abba",), ("",), ("zz/é",), ("ccc",)], "text string")
    for r in score_texts(asked, fit_models(df, 3), 3, heavy).collect():
        assert r.ratio == pytest.approx(good(r.text) - bad(r.text))


def test_rules_hosts_and_awkward_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org", "http://org/x",
            "http://notexample.org.com/fr/", "http://b.com/de/1", "http://com/fr/q", "http://Éa.COM/fr/", "x://h?p/q",
            "http://www.example.org/en/15", "http://www.example.org/en/5"]
    urls += [f"http://good{k}.org/fine/{k}" for k in range(40)] + [f"http://bad{k}.com/de/awful{k}" for k in range(40)]
    urls += ["http://new.net/fine/3", "http://new.net/de/awful9"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls + urls[:5])],
                                  "page_id long, url string, ratio string")
    got = filter_urls(pages).collect()
    assert len(got) == len(urls) + 5
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [by[k][:3] for k in range(14)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"),
        ("example.org", "", None), ("org", "/x", "org/"), ("notexample.org.com", "/fr/", "com/fr/"), ("b.com", "/de/1", "com/de/"),
        ("com", "/fr/q", "com/fr/"), ("Éa.com", "/fr/", "com/fr/"), ("h", "", None),
        ("www.example.org", "/en/15", "example.org/en/1"), ("www.example.org", "/en/5", "org/")]
    assert by[4][3] == by[8][3] == by[12][3] == "block" and by[6][3] == by[13][3] == "allow"
    n = len(urls)
    assert by[n - 2][3] == "allow" and by[n - 1][3] == "block"
    assert all(by[n + k] == by[k] for k in range(5))


def test_one_sided_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.org/")], "page_id long, url string")
    assert {r.verdict for r in filter_urls(pages).collect()} == {"allow"}
    assert filter_urls(pages.where("false")).collect() == []


def test_models_count_every_ruled_url(spark):
    urls = [f"http://good{k}.org/fine/{k}" for k in range(30)] + [f"http://bad{k}.com/de/awful{k}" for k in range(30)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, "http://new.net/fine/3"])], "page_id long, url string")
    good, bad = (plain_model([(u[7:], 1) for u in some], 4) for some in (urls[:30], urls[30:]))
    got = {r.page_id: r.ratio for r in filter_urls(pages).collect()}
    assert got[60] == pytest.approx(good("new.net/fine/3") - bad("new.net/fine/3")) and got[0] is None
