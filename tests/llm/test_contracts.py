"""URL rules of equal length and very long URLs; benchmark items under every alignment."""

import numpy as np

from tarifa.llm import decontaminate, url_reputation


def test_ties_of_rules_and_very_long_urls(spark):
    rules = [url_reputation.Rule("a.net", "/xy", "allow"), url_reputation.Rule("net", "/xyza", "block"), url_reputation.Rule("net", "/", "block")]
    urls = [(1, "http://a.net/xyza"), (2, "http://a.net/xyz"), (3, "http://b.net/xyza"), (4, "http://b.net/" + "p" * 200_000), (5, "http://" + "h" * 100_000 + ".net/"), (6, "://"), (7, "http://?q")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.judge_urls(pages, spark.createDataFrame([], "url string, bad boolean"), rules).collect()}
    # a.net/xy and net/xyza are eight characters each: the first of them decides.
    assert got == {1: ("net/xyza", "block") if len("net/xyza") > len("a.net/xy") else ("a.net/xy", "allow"), 2: ("a.net/xy", "allow"), 3: ("net/xyza", "block"), 4: ("net/", "block"), 5: ("net/", "block"), 6: (None, "allow"), 7: (None, "allow")}
    turned = {r.page_id: r.rule for r in url_reputation.judge_urls(pages, spark.createDataFrame([], "url string, bad boolean"), [rules[1], rules[0], rules[2]]).collect()}
    assert turned[1] == "net/xyza"


def test_items_are_found_as_a_sliding_comparison_finds_them(spark):
    """All alignments without seeds, over items of 13 to 40 words: some copied with substitutions, some in part, some not at all."""
    r = np.random.default_rng(8)
    items = {k: [f"i{k}w{j}" if r.random() < 0.7 else f"common{r.integers(12)}" for j in range(r.integers(13, 41))] for k in range(30)}
    docs = {}
    for d in range(300):
        item = items[int(r.integers(30))]
        a = int(r.integers(0, len(item)))
        part = item[a : a + int(r.integers(6, 41))] if d % 2 else item
        part = [f"s{r.integers(10**6)}" if r.random() < 0.12 else w for w in part]
        docs[d] = [f"common{r.integers(12)}" for _ in range(r.integers(0, 20))] + part + [f"common{r.integers(12)}" for _ in range(r.integers(0, 20))]

    def holds(doc, item):
        for shift in range(-len(item), len(doc)):
            same = [doc[k + shift] == w for k, w in enumerate(item) if 0 <= k + shift < len(doc)]
            if any(100 * sum(same[i : i + 13]) >= 80 * 13 for i in range(len(same) - 12)):
                return True
        return False

    want = {(d, k) for d, doc in docs.items() for k, item in items.items() if holds(doc, item)}
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{key} long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got <= want and len(want) > 100
    assert len(got) == len(want), sorted(want - got)


def test_hosts_are_blocked_by_what_is_known_of_them(spark):
    """Bad, good, little known and unseen hosts of a bad domain; addresses in numbers by themselves."""
    outcomes = [(f"https://{h}/{k}", k < bad) for h, n, bad in [("bad.spam.com", 60, 58), ("good.spam.com", 60, 2), ("few.spam.com", 2, 2), ("fine.org", 80, 1), ("other.org", 70, 0), ("10.0.0.1", 50, 50), ("10.9.0.1", 50, 0), ("edge.net", 40, 22)] for k in range(n)]
    hosts = ["bad.spam.com", "good.spam.com", "few.spam.com", "new.spam.com", "fine.org", "10.0.0.1", "10.9.0.1", "edge.net", "unseen.dev"]
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    found = {r.host: r for r in url_reputation.judge_urls(pages, spark.createDataFrame(outcomes, "url string, bad boolean"), []).collect()}
    assert {h for h in hosts if found[h].verdict == "block"} == {"bad.spam.com", "10.0.0.1"}
    assert all((found[h].bad_at_least > 0.5) == (found[h].verdict == "block") for h in hosts)
    assert found["few.spam.com"].bad_at_least < 0.5 < found["bad.spam.com"].bad_at_least
