"""Pages of whole sites: notices of any length, sections with telling names, small hosts."""

import random

import pytest

from lexmill.llm import html_extract as H

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(4000)]


def words(n):
    return " ".join(RNG.choices(WORDS, k=n))


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"].split("\n\n") for r in H.extract(df).collect()}


@pytest.mark.parametrize("n_notice", [12, 120])
def test_notice_in_the_article_goes_whatever_its_length(spark, n_notice):
    notice, texts = [words(n_notice), words(n_notice)], [[words(25) for _ in range(4)] for _ in range(12)]
    page = lambda ps: f"<html><body><div class=x><div class=y>{''.join(f'<p>{p}</p>' for p in [*ps, *notice])}</div></div></body></html>"
    got = extracted(spark, [(i, f"http://a.example/{i}", page(ps)) for i, ps in enumerate(texts)])
    assert [got[i] for i in range(12)] == texts


def test_copies_of_one_article_keep_their_text(spark):
    paragraphs = [words(60) for _ in range(4)]
    rows = [(i, f"http://copies.example/{i}", f"<html><body><div class=x><div class=y>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>Read {i} times</p></div></div></body></html>") for i in range(12)]
    others = [[words(60) for _ in range(4)] for _ in range(5)]
    rows += [(20 + i, f"http://copies.example/{20 + i}", f"<html><body><div class=x><div class=y>{''.join(f'<p>{p}</p>' for p in ps)}<p>Read {i} times</p></div></div></body></html>") for i, ps in enumerate(others)]
    got = extracted(spark, rows)
    assert all(got[i][:4] == paragraphs for i in range(12)) and all(got[20 + i][:4] == ps for i, ps in enumerate(others))


@pytest.mark.parametrize(("name", "kept"), [("legal", True), ("more-text", True), ("form-of-government", True), ("comment-free", True), ("comments", False), ("comment-list", False), ("ad-slot", False), ("newsletterSignup", False), ("cookie_banner", False), ("related-links", False)])
def test_names_of_sections(spark, name, kept):
    html = f"<html><body><article><h1>Title</h1><p>{words(30)}</p><section class='{name}'><p>Section text of some length</p></section><p>{words(30)}</p></article></body></html>"
    assert ("Section text of some length" in extracted(spark, [(1, "http://one.example/", html)])[1]) == kept


def test_small_hosts_borrow_a_wrapper(spark):
    def page(text, links):
        return f"<html><body><div class=top><p>{links}</p></div><div class=main><div class=side><p>{words(9)}. {words(9)}.</p></div><div class=text>{''.join(f'<p>{p}</p>' for p in text)}</div></div></body></html>"

    big = [[words(50) for _ in range(4)] for _ in range(8)]
    rows = [(i, f"http://big.example/{i}", page(t, "Home and all the news of the day")) for i, t in enumerate(big)]
    small = {100 + i: [words(50) for _ in range(3)] for i in range(3)}
    rows += [(i, f"http://small{i}.example/", page(t, "Welcome to our pages, dear reader")) for i, t in small.items()]
    got = extracted(spark, rows)
    assert all(got[i] == t for i, t in small.items()) and all(got[i] == t for i, t in enumerate(big))


def plain_mapping(a, b):
    """Simple tree matching without limits, ties traced from the end: first a child of ``a`` is left out, then one of ``b``."""
    known = {}

    def table(x, y):
        rows = [[0] * (len(b.kids[y]) + 1)]
        for i in a.kids[x]:
            row = [0]
            for k, j in enumerate(b.kids[y]):
                row.append(max(rows[-1][k + 1], row[k], rows[-1][k] + weight(i, j)))
            rows.append(row)
        return rows

    def shape(t, n):
        return t.label[n], tuple(shape(t, k) for k in t.kids[n])

    shapes = [[shape(t, n) for n in range(len(t.label))] for t in (a, b)]

    def weight(x, y):
        key = shapes[0][x], shapes[1][y]
        if key not in known:
            known[key] = 1 + table(x, y)[-1][-1] if a.label[x] == b.label[y] else 0
        return known[key]

    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        rows, i, j = table(x, y), len(a.kids[x]), len(b.kids[y])
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((a.kids[x][i], b.kids[y][j]))
    return out


def test_long_lists_are_matched_by_all_below_them():
    """Some 500 siblings of different shapes on either side."""
    rng = random.Random(2)

    def items():
        return "".join(f"<div>{''.join(f'<{t}>#</>' for t in rng.choices(['p', 'h3', 'ul', 'pre'], k=rng.randrange(3, 8)))}</>" for _ in range(620))

    a, b = H.Tree(f"<body>{items()}</>"), H.Tree(f"<body>{items()}</>")
    m = H._Matching(a, b)
    assert min(len({of[k] for k in t.kids[1]}) for t, of in ((a, m.of_a), (b, m.of_b))) > 500
    got, want = m.mapping(), plain_mapping(a, b)
    assert len(got) == len(want) and all(a.label[x] == b.label[y] and (x == 0 or got[a.up[x]] == b.up[y]) for x, y in got.items())


def test_ties_fall_alike_at_every_size():
    for n, k in ((23, 10), (2300, 1000)):
        a, b = H.Tree("<body>" + "<p>##</>" * n + "</>"), H.Tree("<body>" + "<p>#<hr></></>" * k + "</>")
        assert H._Matching(a, b).mapping() == plain_mapping(a, b)


@pytest.mark.parametrize("n", [40, 540])
def test_labels_in_long_lists_go(spark, n):
    """Pages with a few sections more at their beginning: the labels of the others, the same on all pages, are template."""
    codes = ["".join(f"<{t}></{t}>" for t in RNG.choices(["h4", "h5", "h6", "pre"], k=12)) for _ in range(n)]
    rows, want = [], {}
    for i in range(6):
        own = [[words(20) for _ in range(1 + i)] for _ in range(n + i)]
        new = ["".join(f"<{t}></{t}>" for t in RNG.choices(["h4", "h5", "h6", "pre"], k=12)) for _ in range(i)]
        sections = [f"<div class=item>{code}{'' if k < i else f'<p>Label of section {k - i}</p>'}{''.join(f'<p>{p}</p>' for p in ps)}</div>" for k, (code, ps) in enumerate(zip(new + codes, own))]
        rows.append((i, f"http://long.example/{i}", f"<html><body><div class=x><div class=y>{''.join(sections)}</div></div></body></html>"))
        want[i] = [p for ps in own for p in ps]
    got = extracted(spark, rows)
    assert got == want
