"""Densities and content of pages against a plain recursive count, and pages of many shapes."""

import math
import random
import time
from xml.etree import ElementTree

import pytest

from tarifa.llm.html_density import Page, densities, main_text


def tree(r, depth):
    """A random page body: sections, paragraphs and links."""
    if depth == 0 or r.random() < 0.3:
        words = " ".join(r.choice(["alpha", "beta", "a", "longerword"]) for _ in range(r.randrange(1, 30)))
        return f"<p>{words} {'<a>link text</a> more' if r.random() < 0.3 else ''}</p>"
    return f"<div>{''.join(tree(r, depth - 1) for _ in range(r.randrange(1, 5)))}</div>"


def plain(e, share):
    """The density of an element from its own text alone."""
    chars = len("".join("".join(e.itertext()).split()))
    tags = max(len(list(e.iter())) - 1, 1)
    links = [x for x in e.iter("a")]
    link_chars = sum(len("".join("".join(x.itertext()).split())) for x in links)
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(chars / max(link_chars, 1) * tags / max(len(links), 1), 1.0)) / math.log(base + 1e-9) if base > 1 + 1e-6 else chars / tags * math.log(max(chars / max(link_chars, 1) * tags / max(len(links), 1), 1.0))


@pytest.mark.parametrize("seed", range(20))
def test_densities_are_those_of_a_recursive_count(seed):
    r = random.Random(seed)
    html = f"<body>{''.join(tree(r, 4) for _ in range(3))}</body>"
    root = ElementTree.fromstring(html)
    chars = len("".join("".join(root.itertext()).split()))
    share = sum(len("".join("".join(x.itertext()).split())) for x in root.iter("a")) / chars
    body, dense, *_ = densities(Page(html))
    # Elements come in page order in both; the first of the page is the page itself.
    expected = [plain(e, share) for e in root.iter()]
    assert body == 1 and dense[1:] == pytest.approx(expected)
    core = max(root.iter(), key=lambda e: sum(plain(c, share) for c in e))
    text = main_text(html)
    assert all(" ".join("".join(p.itertext()).split()) in text for p in core.iter("p") if len(list(p.iter("a"))) < 3)


PARTS = [f"<p>Paragraph {k} of the text, which has enough words in it to count as content of this page.</p>" for k in range(8)]
MENU = "<div><ul>" + "".join(f"<li><a href='/{k}'>Menu entry {k}</a></li>" for k in range(12)) + "</ul></div>"
WANT = "\n".join(p[3:-4] for p in PARTS)


@pytest.mark.parametrize("wrap", ["<div>%s</div>", "<section><div>%s</div></section>", "<td>%s</td>", '<div class="post promoted">%s</div>', "<article>%s</article>"])
def test_density_finds_the_text_without_names(wrap):
    assert main_text(f"<body>{MENU}{wrap % ''.join(PARTS)}{MENU}</body>") == WANT


def test_lists_of_links_in_the_article_go_and_short_paragraphs_stay():
    inner = f"<h1>Hi</h1>{PARTS[0]}<p>Yes.</p>{MENU}{''.join(PARTS[1:])}<p>So <a href=x>it</a> is.</p>"
    got = main_text(f"<body><article>{inner}<div class='comments'><p>{'A reader says a lot. ' * 20}</p></div></article></body>")
    assert got == "\n".join(["Hi", PARTS[0][3:-4], "Yes.", *[p[3:-4] for p in PARTS[1:]], "So it is."])


@pytest.mark.parametrize("n", [10, 8000, 9000, 300_000])
def test_attributes_of_any_length_are_no_text(n):
    got = main_text(f"""<body><article>{PARTS[0]}<img alt="{'x' * n} > y" title='{'z' * n} > "'>{PARTS[1]}<a title=it's href=x>link</a></article></body>""")
    assert got == f"{PARTS[0][3:-4]}\n{PARTS[1][3:-4]}\nlink"


def test_broken_markup_takes_no_time_and_loses_no_text():
    assert main_text(f"<body><div>{''.join(PARTS)}<p title=\"never closed>tail</p></div>").endswith("tail")
    for bad in ("<a '\">", '<a b="', "<a b='\">", "<!--", "<x", "< ", "<a b='", "</p"):
        main_text(bad * 20_000)


def test_addresses_without_quotes_are_links():
    bare = MENU.replace("'", "").replace(">Menu", "/>Menu")
    assert "<a href=/3/>" in bare
    assert main_text(f"<body><article>{PARTS[0]}{bare}{''.join(PARTS[1:])}</article></body>") == WANT
    assert main_text(f"<body><article>{PARTS[0]}<div class=ad/>BUY NOW</div>{''.join(PARTS[1:])}</article></body>") == WANT
    assert main_text(f"<body><article>{PARTS[0]}<br/>more<img src=x /> of it<p/>new</article></body>") == f"{PARTS[0][3:-4]}\nmore of it\nnew"


def test_reader_comments_go():
    said = "<p>A reader says a lot about this page, and more than that.</p>" * 6
    for name in ('id="discussion"', "class='comments-area'", "class=kommentare"):
        assert main_text(f"<body><article>{''.join(PARTS)}<section {name}>{said}</section></article></body>") == WANT


@pytest.mark.parametrize(
    "html",
    ["<p><button>" + "<b>" * 60_000 + "<div></div>" * 60_000, "<div>" * 200_000 + "deep", "<ul><li>" * 60_000, "<table><tr><td>" * 40_000, "<p>" + "<i>" * 100_000 + "<p>" * 100_000, "<li>" * 250_000, "<b>" * 100_000 + "</i>" * 250_000],
)
def test_nesting_takes_time_in_proportion(html):
    began = time.perf_counter()
    main_text(f"<body>{html}")
    assert time.perf_counter() - began < 20


def content(e, share):
    """Which elements of a tree without articles, names and lists of links are content, by the definition."""
    every = list(e.iter())
    dense = {x: plain(x, share) for x in every}
    total = {x: sum(dense[c] for c in x) for x in every}
    up = {c: x for x in every for c in x}
    size = {x: len("".join("".join(x.itertext()).split())) for x in every}
    core = max(every, key=lambda x: (total[x], size[x], -every.index(x)))
    path = [core]
    while path[-1] is not e:
        path.append(up[path[-1]])
    threshold = min(dense[x] for x in path)
    chosen = {core}
    for x in every:
        if size[x] and x not in path and dense[x] >= threshold:
            best = max(x.iter(), key=lambda y: total[y])
            chosen.add(best if total[best] else x)
    kept = set()
    for x in every:
        if (x in chosen or up.get(x) in kept) and not (x not in path and dense[x] < threshold and x.tag in ("p", "div") and len(list(x.iter("a"))) > 2 and 2 * sum(len("".join("".join(a.itertext()).split())) for a in x.iter("a")) > size[x]):
            kept.add(x)
    return kept


@pytest.mark.parametrize("seed", range(30))
def test_content_is_what_the_definition_says(seed):
    r = random.Random(100 + seed)
    html = f"<body>{''.join(tree(r, 4) for _ in range(3))}</body>"
    root = ElementTree.fromstring(html)
    chars = len("".join("".join(root.itertext()).split()))
    share = sum(len("".join("".join(x.itertext()).split())) for x in root.iter("a")) / chars
    kept = content(root, share)
    wanted = [" ".join("".join(p.itertext()).split()) for p in root.iter("p") if p in kept]
    assert main_text(html) == "\n".join(w for w in wanted if w)
