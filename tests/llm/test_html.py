"""Main text extraction: densities by their definition, hostile pages, and pages whose names mislead."""

import math
import random
import time
import xml.etree.ElementTree as ET

import pytest

from marquee.llm import html_text

P = "<p>{}</p>".format
WORDS = "some words of a paragraph that is long enough to count as text of the page "


def page(rng, depth=0):
    """A random well-formed tree whose blocks hold either blocks or text with links."""
    if depth == 4 or depth > 1 and rng.random() < 0.5:
        tag = rng.choice(["p", "div", "h2", "ul"])
        inner = "".join(rng.choice(["{}", "<a>{}</a> ", "<b>{}</b> ", "<i>x<a>{}</a></i> "]).format(WORDS[: rng.randint(1, 70)]) for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{tag}>"
    return "<div>" + "".join(page(rng, depth + 1) for _ in range(rng.randint(1, 4))) + "</div>"


def count(node, links_only=False):
    """Characters and tags below a node, or those of its links."""
    chars = sum(len("".join(t.split())) for t in node.itertext())
    if not links_only:
        return chars, sum(1 for _ in node.iter()) - 1
    links = [x for x in node.iter("a")]
    return (count(node) if node.tag == "a" else (sum(count(x)[0] for x in links), len(links)))


def density(node, body):
    c, t = count(node)
    if not c:
        return 0.0
    lc, lt = count(node, True)
    bc, blc = count(body)[0], count(body, True)[0]
    plain, lc, lt, t = max(1, c - lc), max(1, lc), max(1, lt), max(1, t)
    x = c * t / (lc * lt)
    return max(0.0, c / t * math.log(x) / math.log(math.log(c * lc / plain + blc / bc * c + math.e))) if x > 1 else 0.0


@pytest.mark.parametrize("seed", range(25))
def test_densities_and_heart(seed):
    source = f"<html><body>{page(random.Random(seed))}{page(random.Random(seed + 1000), 1)}</body></html>"
    tree = ET.fromstring(source)
    body = tree.find("body")
    root, nodes = html_text.parse(source)
    nodes = html_text.wrap_runs(nodes)
    html_text.measure(nodes)
    plain = list(tree.iter())
    assert [n.tag for n in nodes] == [x.tag for x in plain]
    inline = {"a", "b", "i"}
    sums = []
    for n, x in zip(nodes[1:], plain[1:]):
        d = density(x, body)
        assert n.density == pytest.approx(d)
        blocks = [y for y in x if y.tag not in inline and count(y)[0]]
        sums.append(sum(density(y, body) for y in blocks) if blocks else d * (x.tag not in inline))
    assert root.best.total == pytest.approx(max(sums))


INLINE_TAGS = {"a", "b", "i"}


def plain_selection(tree):
    """The text by the definition: heart, threshold, further parts, what stands with them, and link-dense parts within."""
    body = tree.find("body")
    parent = {x: y for y in tree.iter() for x in y}
    d = {x: density(x, body) for x in body.iter()}
    c, lc = {x: count(x)[0] for x in body.iter()}, {x: count(x, True) for x in body.iter()}
    blocks = lambda x: [y for y in x if y.tag not in INLINE_TAGS and c[y]]
    total = {x: (sum(d[y] for y in blocks(x)) if blocks(x) else d[x]) if x.tag not in INLINE_TAGS else 0.0 for x in body.iter()}
    order = {x: k for k, x in enumerate(body.iter())}
    best = lambda top: max((x for x in top.iter() if x.tag not in INLINE_TAGS and c[x]), key=lambda x: (total[x], -count(x)[1], -order[x]))

    def ways(x):
        while x in parent:
            x = parent[x]
            yield x

    heart = best(body)
    threshold = min(d[x] for x in [heart, *ways(heart)] if x in d)
    taken, leads = {heart}, set(ways(heart))

    def visit(x):
        if x in taken:
            return
        if x not in leads:
            if x.tag in INLINE_TAGS or d[x] < threshold or 2 * lc[x][0] >= c[x]:
                return
            y = best(x)
            taken.add(y)
            leads.update(ways(y))
            if y is x:
                return
        for y in blocks(x):
            visit(y)

    visit(body)
    flow = {"h2", "p", "ul"}

    def collected(x):
        if x in taken:
            return [x]
        own = blocks(x)
        sure = [k for k, y in enumerate(own) if y in taken or y in leads]
        whole = any(own[k] in taken for k in sure)
        loose = lambda y: 2 * lc[y][0] >= c[y]
        keep = {k for k in range(sure[0], sure[-1] + 1) if k in sure or not loose(own[k])}

        def beside(y, before):
            z = y
            while z.tag == "div" and len(blocks(z)) == 1:
                z = blocks(z)[0]
            if before and z.tag == "h2":
                return True
            return whole and (y.tag in flow or y.tag == "div" and x.tag not in ("html", "body") and not lc[y][1])

        for step, k in ((-1, sure[0] - 1), (1, sure[-1] + 1)):
            while 0 <= k < len(own) and not loose(own[k]) and beside(own[k], step < 0):
                keep.add(k)
                k += step
        return [z for k in sorted(keep) for z in (collected(own[k]) if own[k] in leads and own[k] not in taken else [own[k]])]

    def lines(x):
        inner = [y for y in x if y.tag not in INLINE_TAGS]
        if not inner:
            return [" ".join("".join(x.itertext()).split())]
        return [z for y in inner if not (y.tag in ("div", "ul") and c[y] and d[y] < threshold and lc[y][1] > 1 and 2 * lc[y][0] >= c[y]) for z in lines(y)]

    return [z for x in collected(body) for z in lines(x) if z]


@pytest.mark.parametrize("seed", range(60))
def test_selection(seed):
    rng = random.Random(seed)
    source = f"<html><body>{page(rng)}{page(rng, 1)}{page(rng, 1)}</body></html>"
    assert html_text.extract(source).split("\n\n") == plain_selection(ET.fromstring(source))


TEXT = [WORDS.strip() + f" {k}." for k in range(6)]
BODY, WHOLE_TEXT = "".join(map(P, TEXT)), "\n\n".join(TEXT)
NAV = "<nav><a href=/>Home</a></nav>"
STORIES = "<h3>More</h3><p>One story about a thing that happened</p><p>Other story text here too</p>"
COOKIES = "We use cookies to improve your experience on this site."


@pytest.mark.parametrize(
    "source, before, after",
    [
        (f"<article>{BODY}<section id='comments'>{P(WORDS * 2) * 2}</section></article>", "", ""), (f"<article>{BODY}<div id='reader-comments'>{P(WORDS * 2) * 2}</div></article>", "", ""),
        (f"<article>{BODY}<ul class='user-comments'><li>{WORDS}</li><li>{WORDS}</li></ul></article>", "", ""), (f"<article>{BODY}<p class='ad'>Buy this now</p>{P('last words')}</article>", "", "\n\nlast words"),
        (f"<article>{BODY}<p>Then <span class='advert'>Buy now</span> end.</p></article>", "", "\n\nThen end."), *[(f"<article>{BODY}<div class='{c}'>Buy this thing now</div>{P('last')}</article>", "", "\n\nlast") for c in ("google-ad", "story-ad", "adbox")],
        (f"<article>{BODY}<p class='cookie-notice'>{COOKIES}</p></article>", "", ""), (f"<div>{BODY}</div><div>{COOKIES}</div>", "", ""), (f"<article>{BODY}<div>{COOKIES}</div></article>", "", ""), (f"<article>{BODY}<p>{COOKIES}</p></article>", "", ""),
        (f"<article>{BODY}</article><div class='more-stories'>{STORIES}</div>", "", ""), (f"<article>{BODY}<div class='more-stories'>{STORIES}</div></article>", "", ""),
        (f"<table><tr><td><a href=1>menu</a><br><a href=2>menu2</a></td><td>{BODY}</td></tr></table>", "", ""), (f"<article><div class=lead>A short lead.</div><div>{BODY}</div><div class=byline>By Me.</div></article>", "A short lead.\n\n", "\n\nBy Me."),
        (f"<article><div>{BODY}</div><div>Short tail.</div></article>", "", "\n\nShort tail."), (f"<article><div class=hero><h1>The Title</h1></div><div>{BODY}</div></article>", "The Title\n\n", ""),
        (f"<div class=hero><h1>The Title</h1></div><div>{BODY}</div><div>Copyright 2020 Site</div>", "The Title\n\n", ""), (f"<article>{P('We use cookies in this recipe, baked for an hour.')}{BODY}</article>", "We use cookies in this recipe, baked for an hour.\n\n", ""),
    ],
    ids=range(20),
)
def test_what_belongs_to_the_article(source, before, after):
    assert html_text.extract(f"<body>{NAV}{source}<footer>f</footer></body>") == before + WHOLE_TEXT + after


def test_repeated_rows_and_ties(spark):
    tie = f"<body><div>{P(TEXT[0])}</div><hr><div>{P(TEXT[0])}</div></body>"
    rows = [(1, "u", tie, "x"), (1, "u", tie, "x"), (None, None, f"<body>{BODY}</body>", "y"), (2, "v", None, None)]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, WHOLE_TEXT), *[(1, html_text.extract(tie))] * 2, (2, "")] and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "hostile",
    ["<a" * 200_000, "<a '" * 100_000, '<a ">' * 99_999, "<a '\"><b \"'>" * 40_000, "<div>" * 80_000 + "</b>" * 80_000, "<p><table><td>" + "<span>" * 20_000 + "<h1></h1>" * 20_000,
     "<" * 300_000, "<!-" * 200_000, "<script>" * 60_000, "<a x='" + "<b>" * 80_000 + "'", "<div class='" + "a " * 200_000 + "'>x", "<li>" * 80_000, "&" * 300_000],
    ids=lambda x: x[:12],
)
def test_time_follows_length(hostile):
    began = time.process_time()
    html_text.extract(hostile)
    assert time.process_time() - began < 10


def test_names_that_mislead():
    text = [WORDS.strip() + f" {k}." for k in range(6)]
    body = "".join(map(P, text))
    whole = "\n\n".join(text)
    for before, after in [
        ('<div class="layout has-sidebar">', "</div>"), ('<div data-role="site search">', "</div>"), ('<div class="social-impact"><form><input></form>', "</div>"), ("<main class=header>", "</main>"),
        ("<article class='related'>", "</article>"), ('<section id="search-methods">', "</section>"), ('<div title="class=comments">', "</div>"),
    ]:
        assert html_text.extract(f"<body><nav><a href=/>Home</a></nav>{before}{body}{after}<footer>f</footer></body>") == whole, before
    comment = f"<article class='comment'>{P(WORDS * 3)}</article>"
    assert html_text.extract(f"<main>{body}{comment}{comment}</main>") == whole
    assert html_text.extract(f"<article><header><h1>Title</h1></header>{body}</article>") == f"Title\n\n{whole}"
    assert html_text.extract(f"<header><h1>Site</h1></header><article>{body}<footer>By me</footer></article>") == whole


def test_split_articles():
    def part(n, size=3):
        return [f"{WORDS}{n} {k}." for k in range(size)]

    a, b, c = part("a", 4), part("b"), part("c")
    items = ["One thing of a list.", "Another thing of it."]
    rest = "<div><a href=1>first link</a> <a href=2>second link</a></div>"
    source = f"<body><div><h1>T</h1><div>{''.join(map(P, a))}</div><ul><li>{'</li><li>'.join(items)}</li></ul><div>{''.join(map(P, b))}</div><div>{''.join(map(P, c))}</div></div>{rest}</body>"
    assert html_text.extract(source).split("\n\n") == ["T", *a, *items, *b, *c]
    two = "".join(f"<article>{''.join(map(P, x))}</article>" for x in (a, b))
    assert html_text.extract(f"<body>{two}{rest}</body>").split("\n\n") == [*a, *b]
    assert html_text.extract(f"<body><div>{a[0]}<br><br>{a[1]}<p>{a[2]}</p>{a[3]}<div class=ad>Buy</div>end</div>{rest}</body>").split("\n\n") == [f"{a[0]} {a[1]}", a[2], a[3], "end"]
