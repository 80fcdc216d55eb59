"""Each training-data operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarifa.llm import chat_windows, decontaminate, html_density, lm_scoring, packing, quality_rules, simhash, simple8b, token_counts, url_reputation
from tarifa.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer_path

DOCS = "doc_id long, text string, key string, block long, fingerprint string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


ODD = [None, "", " \n\t ", "one", "Two\x0bwords", "\u00a0 nbsp\u2003em", "a\x00b", "naïve Ünïcode 東京 😀", "x" * 70_000, text(30, 1), text(30, 1), text(3000, 2), "tab\tand  two spaces\n\nand lines ", "<|endoftext|> literal"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, "f") for i, t in enumerate(ODD)]
    rows += [(3, "one", "k", 1, "f"), (3, "one", "k", 1, "f"), (None, "no id here", "k", 1, "f"), (None, None, None, None, None), (-7, "negative id", "k", 1, "f")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def ids_by(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, end]


def split(s):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", s or "") if w]


def lowered(s):
    return (s or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# 1


def test_token_counts_equal_a_search_of_each_word(docs, none):
    scores = token_counts.scored_pieces(tokenizer_path(token_counts.PIECES))
    unknown = min(scores.values()) - token_counts.UNKNOWN_PENALTY

    def best(word):
        s = token_counts.MARK + word
        out = [(0.0, 0)]
        for end in range(1, len(s) + 1):
            found = (-math.inf, 0)
            for begin in range(max(0, end - 40), end):
                if (p := scores.get(s[begin:end])) is not None and out[begin][0] + p > found[0]:
                    found = (out[begin][0] + p, out[begin][1] + 1)
            if s[end - 1] not in scores and out[end - 1][0] + unknown > found[0]:
                found = (out[end - 1][0] + unknown, out[end - 1][1] + len(s[end - 1].encode()))
            out.append(found)
        return out[-1][1]

    got = Counter(map(tuple, token_counts.token_counts(docs).collect()))
    assert got == Counter((i, len(split(t)), sum(map(best, split(t)))) for i, t in rows_of(docs))
    small = Counter(map(tuple, token_counts.token_counts(docs, max_nodes=20).collect()))
    assert small == got
    assert token_counts.token_counts(none).count() == 0


# 2


def test_scores_follow_the_base_formula_and_a_plain_model(spark):
    rows = [(i, text(5 + i % 40, i) + (" RARE%d" % i if i % 3 == 0 else "")) for i in range(120)] + [(500, None), (501, ""), (None, "no id"), (4, text(9, 4)), (4, text(9, 4))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, learned string, block long").repartition(4)
    out = lm_scoring.lm_scores(docs, block_bytes=3000, range_bytes=2000).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            tokens = [*split(lowered(t)), None]
            counts.update(tokens)
            pairs.update(zip([None, *tokens], tokens, strict=False))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in rows:
        tokens = [*split(lowered(t)), None]
        expected[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    # Ranges and blocks don't change the counts; one block and one range give the same sums.
    assert {r.train_tokens for r in lm_scoring.lm_scores(docs).collect()} == {n}


def plain_scores(rows, block_of):
    """doc_id and score of each row by a plain model: dictionaries, one token after the other, weights learned token by token."""
    tokens = [[*split(lowered(t)), None] for _, t in rows]
    learned = [not (i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, _ in rows]

    def model(use):
        words, pairs = Counter(), Counter()
        for t, u in zip(tokens, use, strict=True):
            if u:
                words.update(t)
                pairs.update(zip([None, *t], t, strict=False))
        return words, pairs, sum(words.values()), len(words)

    held = [block_of[k] % lm_scoring.FOLD == 0 for k in range(len(rows))]
    words, pairs, n, v = model([x and not h for x, h in zip(learned, held, strict=True)])
    seen = []
    step = lambda p: round(lm_scoring.STEPS * math.log2(p * (v + 1))) if p else None
    for t, x, h in zip(tokens, learned, held, strict=True):
        if x and h:
            for c, w in zip([None, *t], t, strict=False):
                r = (step(pairs[c, w] / words[c] if words[c] else 0), step(words[w] / n if n else 0))
                seen.append((words[c].bit_length(), *(0.0 if y is None else 2.0 ** (y / lm_scoring.STEPS) for y in r)))

    def em(rows, start, strength):
        now = start
        for _ in range(60):
            total = [s * strength for s in start]
            for _, r2, r1 in rows:
                share = now[0] * r2, now[1] * r1, now[2]
                total = [a + b / sum(share) for a, b in zip(total, share, strict=True)]
            now = [x / (len(rows) + strength) for x in total]
        return now

    pooled = em(seen, [1 / 3] * 3, 3.0)
    weights = {b: em([r for r in seen if r[0] == b], pooled, 20.0) for b in range(20)}
    weights[0] = [0, *(x / sum(weights[0][1:]) for x in weights[0][1:])]
    words, pairs, n, v = model(learned)
    out = []
    for (i, _), t in zip(rows, tokens, strict=True):
        score = 0.0
        for c, w in zip([None, *t], t, strict=False):
            l2, l1, l0 = weights[words[c].bit_length()]
            score += math.log10(l2 * pairs[c, w] / max(words[c], 1) + l1 * words[w] / n + l0 / (v + 1))
        out.append((i, round(score, 4)))
    return out


def test_scores_are_those_of_a_plain_model(spark):
    rows = [(i, text(5 + i % 40, i) + (" RARE%d" % i if i % 3 == 0 else "")) for i in range(150)] + [(500, None), (501, "x" * 70_000), (None, "no id"), (502, text(3000, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len((t or "").encode()) for _, t in rows)
    n_blocks = max(lm_scoring.FOLD, math.ceil(size / 3000))
    blocks = {(r.doc_id, r.text): r.b for r in docs.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("b")).collect()}
    out = [(r.doc_id, round(r.score, 4)) for r in lm_scoring.lm_scores(docs, block_bytes=3000, range_bytes=2000).collect()]
    expected = dict(plain_scores(rows, [blocks[r] for r in rows]))
    assert len(out) == len(rows) and all(abs(s - expected[i]) <= 2e-4 for i, s in out)


def test_mixture_is_a_distribution_and_beats_the_base_on_held_out_texts(spark):
    chain = {w: [WORDS[(k * 7 + j) % 20] for j in range(3)] for k, w in enumerate(WORDS)}

    def walk(seed):
        r, out = np.random.default_rng(seed), ["alpha"]
        for _ in range(60):
            out.append(chain[out[-1]][r.integers(3)])
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk(i)) for i in range(300)], "doc_id long, text string")
    r = lm_scoring.lm_scores(docs, block_bytes=20_000).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.6 * r[1]
    w = lm_scoring.learn_weights([(3, 0, 5, 10), (4, 8, -10_000, 3)])
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all() and w[0, 0] == 0


def test_scores_of_nothing(spark, none):
    assert lm_scoring.lm_scores(none).count() == 0
    only = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:5] for r in lm_scoring.lm_scores(only).collect()] == [(1, False, 1, 1, 1)]


# 3

RULES = [url_reputation.Rule("net", "/", "block"), url_reputation.Rule("example.net", "/en/", "allow"), url_reputation.Rule("example.com", "/de/", "block"), url_reputation.Rule("org", "/fr/", "allow")]


def test_urls_by_rule_and_by_reputation(spark):
    urls = [
        (1, "http://A.example.NET/en/x?q#f"), (2, "https://b.net/"), (3, "https://b.net"), (4, "ftp://example.com/de/1"), (5, "https://notexample.com/de/"), (6, None), (7, "no scheme"), (8, ""),
        (9, "https://x.org/fr/a"), (10, "https://bad.example.org/1"), (11, "https://good.example.info/1"), (12, "https://never.seen.xyz/"), (None, "https://b.net/"), (2, "https://b.net/"), (13, "http://h/a://b"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("https://bad.example.org/%d" % k, True) for k in range(40)] + [("https://good.example.info/%d" % k, k == 0) for k in range(40)] + [(None, None)], "url string, bad boolean")
    out = url_reputation.judge_urls(pages, outcomes, RULES)
    assert out.count() == len(urls)
    got = {r.page_id: r for r in out.collect()}
    assert [got[k].rule for k in (1, 2, 3, 4, 5, 9)] == ["example.net/en/", "net/", None, "example.com/de/", None, "org/fr/"]
    assert (got[1].host, got[1].path, got[13].host, got[13].path) == ("a.example.net", "/en/x", "h", "/a://b")
    assert all((got[k].host, got[k].path, got[k].verdict) == ("", "", "allow") for k in (6, 7, 8))
    assert [got[k].verdict for k in (1, 2, 4, 10, 11, 12)] == ["allow", "block", "block", "block", "allow", "allow"]
    assert url_reputation.judge_urls(pages.limit(0), outcomes.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_reputation.judge_urls(pages.filter("page_id in (10, 12)"), outcomes.limit(0), RULES).collect()} == {"allow"}


def test_bounds_shrink_towards_the_domain(spark):
    outcomes = spark.createDataFrame([(f"h{k}.d.com", b) for k in range(6) for b in [True] * 9 + [False]] + [("one.e.com", True)] + [(f"g{k}.e.com", False) for k in range(20)], "host string, bad boolean")
    hosts = spark.createDataFrame([("new.d.com",), ("one.e.com",), ("new.e.com",)], "host string")
    got = {r.host: r for r in url_reputation.host_reputation(hosts, outcomes).collect()}
    assert got["new.d.com"].bad_share > 0.6 > 0.3 > got["new.e.com"].bad_share
    assert got["one.e.com"].bad_share < 0.75 and got["one.e.com"].bad_at_least < got["one.e.com"].bad_share


# 4


def plain_simhash(t):
    words = split(lowered(t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_equal_all_pairs(spark, docs, none):
    near = [(100 + k, text(400, 5) + f" {k}", "k", 1, "f") for k in range(12)]
    everything = docs.union(spark.createDataFrame(near, DOCS))
    rows = [(i, plain_simhash(t)) for i, t in rows_of(everything)]
    up = list(range(len(rows)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                up[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(k)] = min(smallest.get(root(k), i), i)
    expected = Counter((i, f"{f:016x}", smallest.get(root(k))) for k, (i, f) in enumerate(rows))
    assert Counter(map(tuple, simhash.simhash_groups(everything).collect())) == expected
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("distance", [3, 7])
def test_links_connect_what_all_pairs_connect(spark, distance):
    r = np.random.default_rng(distance)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(20):
            flips = r.choice(64, r.integers(1, distance + 3), replace=False)
            prints.add(int(b) ^ sum(1 << int(k) for k in flips))
    prints = sorted(prints)
    values = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    found = simhash.links(spark.createDataFrame(values, "fingerprint long"), distance, cell=64, pairs=100).collect()

    def parts(edges):
        up = {p: p for p in prints}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(a)] = root(b)
        return {frozenset(q for q in prints if root(q) == root(p)) for p in prints}

    unsigned = [(r.a % 2**64, r.b % 2**64) for r in found]
    all_pairs = [(a, b) for k, a in enumerate(prints) for b in prints[:k] if (a ^ b).bit_count() <= distance]
    assert parts(unsigned) == parts(all_pairs)


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({roots[k] for k in range(n + 1)}) == 1 and roots[1000] == roots[1001] != roots[0]


def test_near_copies_go_and_others_stay(spark, docs, none):
    base = " ".join(f"w{k}" for k in range(300))
    near = [(200 + k, base.replace("w150", f"changed{k}"), "k", 1, "f") for k in range(30)]
    other = [(300 + k, " ".join(f"o{k}x{j}" for j in range(200)), "k", 1, "f") for k in range(10)]
    every = docs.union(spark.createDataFrame(near + other, DOCS))
    out = simhash.drop_near_duplicates(every)
    assert out.columns == every.columns
    ids = [r.doc_id for r in out.collect()]
    assert 200 in ids and not set(range(201, 230)) & set(ids) and set(range(300, 310)) <= set(ids)
    assert ids.count(3) == 1 and 9 in ids and 10 not in ids
    assert len({0, 1, 2} & set(ids)) == 1 and ids.count(None) == 1
    assert simhash.drop_near_duplicates(none).count() == 0


def all_pairs_keep(texts):
    """Places of the texts that stay when every pair at 0.8 or more is a link."""
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    first = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if first[a] != first[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((first[a], first[b]))
                first = [low if f == high else f for f in first]
    return set(first)


def edited(base, r, edits):
    words = list(base)
    for at in r.choice(len(words), edits, replace=False):
        words[at] = f"e{r.integers(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [1 << 17, 6000])
def test_a_family_of_edited_copies_is_as_all_pairs_connect_it(spark, cell):
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    texts = [edited(base, r, 1 + k % 4) for k in range(200)][::-1]
    out = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cell=cell)
    assert {x.doc_id for x in out.collect()} == all_pairs_keep(texts)


def test_pairs_at_least_alike_are_found_whatever_their_fingerprints(spark):
    r = np.random.default_rng(6)
    texts, bands = [], {}
    for k in range(400):
        n = (50, 100, 300)[k % 3]
        base = [f"p{k}x{j}" for j in range(n)]
        other = edited(base, r, max(1, n // (50 + 5 * (k % 7)))) if k % 2 else " ".join(base + [f"q{k}x{j}" for j in range(n * (5 + k % 20) // 100)])
        texts += [" ".join(base), other]
    kept = {x.doc_id for x in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in range(400):
        alike = all_pairs_keep(texts[2 * k : 2 * k + 2]) == {0}
        bits = (simhash.simhash(texts[2 * k]) ^ simhash.simhash(texts[2 * k + 1])).bit_count()
        bands.setdefault((alike, bits > 7), []).append(2 * k + 1 in kept)
        assert 2 * k in kept
    assert len(bands[True, True]) > 20 and not any(bands[True, True]) and not any(bands[True, False])
    assert all(x for (alike, _), stays in bands.items() if not alike for x in stays)


# 5


def base_counts(t):
    t = t or ""
    words = split(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_base_counts_equal_a_plain_count(spark, docs, none):
    extra = [(50, "a b c d e f a b c d e f", "", 1, ""), (51, "x " * 11, "", 1, ""), (52, "l1\nl1\n \n \nl1 \n#$<>|", "", 1, ""), (53, "a b c d e " * 3 + "z", "", 1, "")]
    every = docs.union(spark.createDataFrame(extra, DOCS))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(every, labels).collect()
    expected = Counter()
    for i, t in rows_of(every):
        c = base_counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        expected[i, *c, failed, not failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out) == expected
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_rules_learned_from_labels_hold_on_others(spark):
    rows = [(k, " ".join(("#%d" if k % 2 else "w%d") % ((k * 31 + j) % 500) for j in range(50))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(100)] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert out == {k: k % 2 == 0 for k in range(200)}
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == set(range(0, 200, 2))
    assert quality_rules.learn_rules([]) == []


# 6

PAGE = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body><header>Site</header><nav><a href=/>Home</a> <a href=/a>Other</a></nav>
<div class="content"><h1>Head &amp; line</h1><p>First   paragraph with <b>bold</b> and <a href=x>a link</a>, long enough to count as text.</p>
<p>Second paragraph, also of some length, so that it counts.</p><ul><li>item one of the list</li><li>item two of the list</li></ul></div>
<div class="sidebar">Side <a href=1>l1</a> <a href=2>l2</a></div><div id="comments"><p>Reader comment that is long enough to look like text.</p></div><footer>Foot</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_main_text_of_pages(spark):
    want = "Head & line\nFirst paragraph with bold and a link, long enough to count as text.\nSecond paragraph, also of some length, so that it counts.\nitem one of the list\nitem two of the list"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>plain"), (1, "u", PAGE), (4, "u", "<div>" * 5000 + "deep"), (5, "u", "<p>a < b & c &#x41;&nbsp;d</p>"), (6, "u", "text only")]
    out = html_density.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    got = [(r.page_id, r.text) for r in sorted(out, key=lambda r: (r.page_id is None, r.page_id or 0))]
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, "deep"), (5, "a < b & c A d"), (6, "text only"), (None, "plain")]
    assert html_density.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 7


@pytest.mark.parametrize("wrap", ['<div class="has-sidebar">%s</div>', '<div class="content-with-ads">%s</div>', '<div class="no-comments nav-open">%s</div>', '<div class="post promoted">%s</div>', "<form>%s</form>"])
def test_wrappers_by_name_keep_the_article(wrap):
    body = "".join(f"<p>Paragraph {k} with enough of text in it to count as content of a page.</p>" for k in range(4))
    side = '<div class="sidebar">Side <a href=1>link</a></div><div id="comments"><article class="comment">A comment.</article></div>'
    got = html_density.main_text(f"<body>{wrap % f'<article><h1>Head</h1>{body}</article>{side}'}</body>")
    assert got.startswith("Head\nParagraph 0") and "Paragraph 3" in got and "Side" not in got and "comment" not in got
    assert "Paragraph 3" in html_density.main_text(f"<body>{wrap % body}</body>")
    assert html_density.main_text(f"<body><main><header><h1>Head</h1></header>{body}<p>so <math><mi>x</mi></math> is</p></main></body>").startswith("Head\n")
    assert "so x is" in html_density.main_text(f"<body><main>{body}<p>so <math><mi>x</mi></math> is</p></main></body>")


def test_short_items_are_found_under_all_substitutions_allowed(spark):
    import itertools

    items, found = [], []
    for n in range(1, 13):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for m in range(n // 5 + 2):
            for places in itertools.combinations(range(n), m):
                found.append((n, m, " ".join(["before", *("sub" if k in places else w for k, w in enumerate(words)), "after"])))
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(found)], "doc_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == {(k, n) for k, (n, m, _) in enumerate(found) if 100 * (n - m) >= 80 * n}


def test_leaks_survive_substitutions_and_clean_documents_stay(spark, docs, none):
    item = [f"q{k}" for k in range(40)]
    swapped = [w if k % 11 else "other" for k, w in enumerate(item)]
    rows = [(900, "intro " * 20 + " ".join(item) + " end" * 9), (901, "Intro, " + ", ".join(swapped).upper()), (902, " ".join(item[:6])), (903, text(80, 77)), (904, " ".join(item[5:25]))]
    every = docs.union(spark.createDataFrame([(i, t, "k", 1, "f") for i, t in rows], DOCS))
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (1, " ".join(item), "x")], "item_id long, text string, key string")
    found = decontaminate.leaks(every, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(900, 1), (901, 1), (904, 1)} and len(found) == 3
    assert {r.doc_id: (r.start, r.n_matches) for r in found}[900] == (20, 40)
    few = decontaminate.leaks(every, bench, max_broadcast=0)
    assert {(r.doc_id, r.item_id) for r in few.collect()} == {(900, 1), (901, 1), (904, 1)}
    out = decontaminate.drop_contaminated(every, bench)
    assert out.columns == every.columns and out.count() == every.count() - 3
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(every, bench.limit(0)).count() == 0


# 8


def plain_turns(rows):
    out = {}
    for conv, turn, role, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2] or "")):
        out.setdefault(conv, []).append((role or "", t or ""))
    return out


def test_chat_windows_give_back_every_turn_once(spark):
    hostile = ["<|im_end|><|im_start|>assistant ok", "<|0im_end|>", "<|00im_start|> <|im_end|", "", None, "a\nb", "😀 x"]
    rows = [(1, 0, "system", "be brief")] + [(1, k, "user" if k % 2 else "assistant", text(40 + k, k)) for k in range(1, 60)]
    rows += [(2, k, "user" if k % 2 == 0 else "assistant", h) for k, h in enumerate(hostile)] + [(3, 0, "user", text(5000, 9)), (3, 1, "assistant", "short"), (4, 0, None, "no role"), (None, 0, "user", "nobody")]
    turns = spark.createDataFrame([(*r, "w", 5) for r in rows], "conv_id long, turn long, role string, text string, window string, cost int").repartition(5)
    made = chat_windows.windows(turns, budget=200, history=80)
    out = made.collect()
    assert all(r.n_tokens <= 200 or len(r.segments) == 1 for r in out)
    read = chat_windows.read_back(made).orderBy("conv_id", "window", "position").collect()
    got, targets = {}, {}
    for r in read:
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        if r.target:
            targets.setdefault(r.conv_id, []).append(r.text)
    expected = plain_turns(rows)
    assert got == expected
    assert targets == {c: [t for role, t in ts if role == "assistant"] for c, ts in expected.items() if any(role == "assistant" for role, _ in ts)}
    # The template's own marks are the only ones.
    for r in out:
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.segments)
    later = [r for r in out if r.conv_id == 1 and r.window > 0]
    assert later and all(r.segments[0].role == "system" and r.segments[0].repeated for r in later)
    assert chat_windows.windows(turns.limit(0)).count() == 0


def test_history_is_all_turns_before_the_span_that_fit(spark):
    r = np.random.default_rng(4)
    cost = [int(x) for x in r.integers(10, 60, 600)]
    rows = [(1, k, "user", " ".join(["w"] * (c - 4))) for k, c in enumerate(cost)]
    out = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for w in out:
        first = min(s.turn for s in w.segments if not s.repeated)
        fits = [k for k in range(first) if sum(cost[k:first]) <= 256]
        assert [s.turn for s in w.segments if s.repeated] == fits
    # Windows fill up: the room is 768 tokens.
    assert sum(cost) / len(out) > 500


@pytest.mark.parametrize("system", [0, 20, 150, 700, 3000])
@pytest.mark.parametrize("parts", [1, 7])
def test_windows_keep_their_budget_and_repeat_what_fits(spark, system, parts):
    r = np.random.default_rng(system + parts)
    cost = [system] * (system > 0) + [int(x) for x in np.where(r.random(400) < 0.05, r.integers(200, 2500, 400), r.integers(5, 120, 400))]
    rows = [(1, k, "system" if system and k == 0 else "user", " ".join(["w"] * (c - 4))) for k, c in enumerate(cost)]
    out = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)).collect()
    repeats = 0 < system <= (1024 - 256) // 2
    assert sorted(s.turn for w in out for s in w.segments if not s.repeated) == list(range(len(cost)))
    for w in sorted(out, key=lambda w: w.window):
        own = [s.turn for s in w.segments if not s.repeated]
        assert own == list(range(own[0], own[-1] + 1)) and w.n_tokens == sum(cost[s.turn] for s in w.segments)
        assert w.n_tokens <= 1024 or len(w.segments) == 1
        size, first = sum(cost[k] for k in own), own[0]
        with_system = repeats and first > 0 and size + system <= 1024
        allowed = max(0, min(256, 1024 - size - (system if with_system else 0)))
        fits = [k for k in range(int(repeats), first) if sum(cost[k:first]) <= allowed] if first else []
        assert [s.turn for s in w.segments if s.repeated] == [0] * with_system + fits


def plain_spans(cost, system, budget=1024, history=256, stretch=64):
    """The turns of each span, one turn after the other."""
    out, total, now, part, room, used = [], 0, [], None, budget, 0
    for k, c in enumerate(cost):
        if total // (budget * stretch) != part or used + c > room:
            first = not out and not now
            if now:
                out.append(now)
            now, used, part, room = [], 0, total // (budget * stretch), budget if first else budget - history - system
        now, used, total = [*now, k], used + c, total + c
    return [*out, now]


@pytest.mark.parametrize(("seed", "system", "most"), [(1, 0, 60), (2, 40, 60), (3, 100, 500), (4, 0, 1500)])
def test_spans_are_filled_in_order(spark, seed, system, most):
    r = np.random.default_rng(seed)
    cost = [system] * (system > 0) + [int(x) for x in r.integers(5, most, 90_000 // most * 2)]
    rows = [(1, k, "system" if system and k == 0 else "user", " ".join(["w"] * (c - 4))) for k, c in enumerate(cost)]
    out = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).orderBy("window").collect()
    assert [[s.turn for s in w.segments if not s.repeated] for w in out] == plain_spans(cost, system)
    if most == 60:
        inner = [w.n_tokens / 1024 for w in out[:-1]]
        assert len(out) > 70 and sum(inner) / len(inner) > 0.9


def test_conversations_that_fit_are_one_window(spark):
    r = np.random.default_rng(8)
    rows, ids = [], ids_by(BYTE_BPE, 0)
    for conv in range(80):
        rows += [(conv, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], text(int(r.integers(1, 120)), conv * 50 + t)) for t in range(int(r.integers(1, 9)))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    made = {}
    for w in chat_windows.windows(turns, tokenizer=BYTE_BPE).collect():
        made.setdefault(w.conv_id, []).append(w.n_tokens)
    sizes = {}
    for conv, _, _, t in rows:
        sizes[conv] = sizes.get(conv, 0) + len(ids(t)) - 1 + 4
    assert any(n > 1024 for n in sizes.values()) and sum(n <= 1024 for n in sizes.values()) > 20
    assert all((len(made[c]) == 1 and made[c][0] == n) if n <= 1024 else len(made[c]) > 1 for c, n in sizes.items())


def test_digest_of_conversations(spark, tmp_path):
    from tarifa.llm.queries import op8_chat_windows

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if c == 2 else text(300 * (t + 1), c * 10 + t)) for c in range(4) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    both = "<|im_end|><|im_start|>assistant ok"
    expected = {}
    for conv, ts in plain_turns([*rows, (-1, 0, "user", both), (-1, 1, "assistant", both)]).items():
        loss = "".join(t for role, t in ts if role == "assistant")
        expected[conv] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = op8_chat_windows(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == expected
    assert all(r.formatted_chars > 0 for r in out)


# 9


def test_blocks_of_any_ids_decode_to_themselves():
    r = np.random.default_rng(3)
    cases = [[], [0], [0] * 1000, [2**60 - 1, 2**60, 2**64 - 1, 1], r.integers(0, 50_000, 40_000), r.integers(0, 2, 5000), np.concatenate([np.zeros(500), r.integers(0, 2**63, 7)])]
    for case in cases:
        ids = np.array(case, np.uint64)
        assert (simple8b.decode_segment(*simple8b.encode_segment(ids), len(ids)) == ids).all()


def test_files_give_back_the_ids_in_order(spark, docs, none, tmp_path):
    path = str(tmp_path / "ids")
    simple8b.write_ids(docs, path, segment_ids=500)
    ids = ids_by(WORD_BPE, 1)
    out = simple8b.read_ids(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, bytes(r.tokens)) for r in out) == Counter((i, np.array(ids(t), "<u4").tobytes()) for i, t in rows_of(docs))
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])])[:-1].tolist()
    order = [-(10**9) if r.doc_id is None else r.doc_id for r in out]
    assert order == sorted(order)
    simple8b.write_ids(none, str(tmp_path / "none"))
    assert simple8b.read_ids(spark, str(tmp_path / "none")).count() == 0


# 10


def test_pieces_cover_each_id_once_with_no_padding(docs, none):
    ids = ids_by(BYTE_BPE, 0)
    out = packing.pack(docs, window=64, max_open=3).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.tokens)))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected = Counter()
    for i, t in rows_of(docs):
        x = ids(t)
        expected[i, len(x)] += 1
    for (i, n), pieces in by_doc.items():
        same = [x for j, t in rows_of(docs) if j == i and len(x := ids(t)) == n]
        assert len(same) == expected[i, n]
        assert sum(len(p) // 4 for _, p in pieces) == n * len(same)
        if len(same) == 1:
            pieces.sort()
            assert b"".join(p for _, p in pieces) == np.array(same[0], "<u4").tobytes()
            assert [s for s, _ in pieces] == np.cumsum([0, *[len(p) // 4 for _, p in pieces]])[:-1].tolist()
    for pieces in by_sequence.values():
        pieces.sort()
        total = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
        assert total <= 64 and total & (total - 1) == 0
    assert sum(by_doc and len(v) for v in by_doc.values()) == len(out)
    assert packing.pack(none).count() == 0


def test_placement_follows_the_sum_of_squares():
    p = packing.SquaresPacker(10, 0, 100)
    for size in (6, 6, 3, 4):
        counts = p.counts.copy()
        level = p.level(size)
        p.put(size, np.arange(size, dtype=np.uint32))

        def total(h):
            c = counts.copy()
            c[h] -= h > 0
            c[h + size] += 1
            return (c[1:10] ** 2).sum()

        allowed = [h for h in range(0, 11 - size) if h == 0 or counts[h]]
        assert total(level) == min(map(total, allowed)) and level == max(h for h in allowed if total(h) == total(level))


# The pipeline


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"bench{k}" for k in range(60))
    good = [(k, " ".join(f"d{k}w{j}" for j in range(120)), "en", "s", 1) for k in range(20)]
    rows = [*good, (100, good[0][1], "en", "s", 1), (101, good[1][1] + " more", "en", "s", 1), (102, "lead " + item + " tail", "en", "s", 1), (103, "few words", "en", "s", 1), (104, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert sorted(r.doc_id for r in now.collect()) == list(range(20))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = ids_by(BYTE_BPE, 0)
    assert {r.doc_id: r.doc_tokens for r in out} == {k: len(ids(t)) for k, t, *_ in good}
    assert json.dumps(sorted({r.doc_id for r in out})) == json.dumps(list(range(20)))
