import random
import time
from collections import Counter, defaultdict

import pytest

from dyadic.llm import html_template as H

SCHEMA = "page_id long, url string, html string, host string, text string"


def alone(page):
    parsed = H.parse(page)
    return H.article(parsed, H.alone(parsed))


def test_places():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><p>Site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="cookie-notice">We use cookies</div>
    <main><article><h1>Big &amp; small</h1><p>One <b>bold
    </b>word.<br>Next&nbsp;line<p>Two &eacute;&#39;s</p><form><label>Mail</label><input></form><div class="ad">Buy</div><ul><li>first<li>second</ul>
    <section id="comments"><p>Nice!</p></section></article></main><aside>Side</aside><footer>&copy; us</footer></body></html>"""
    assert alone(page) == "Big & small\n\nOne bold word. Next line\n\nTwo é's\n\nfirst\n\nsecond"


@pytest.mark.parametrize("page,text", [("", ""), ("<p>a", "a"), ("plain", "plain"), ("<script>x", ""), ("<div><p>a<div>b</p>c", "a\n\nb\n\nc"), ("a &lt;b&gt; c", "a <b> c"), ("<p hidden>x</p><p>y", "y"), ("</div></p>z", "z"), ("<table><tr><td>a<td>b</table>", "a b"), ("<a href='x>y'>t</a> long enough text", "t long enough text")])
def test_small_pages(page, text):
    assert alone(page) == text


def test_template_text_is_no_slot(spark, words):
    """A host whose article tag is missing: what all its pages share goes, what differs stays."""
    rng = random.Random(5)
    rows, texts = [], []
    for k in range(12):
        body = " ".join(rng.choice(words) for _ in range(30))
        texts.append(body)
        rows.append((k, f"http://h.example/{k}", f"<html><body><div>Welcome to our site</div><div><p>{body}</p></div><div>All rights reserved</div></body></html>", "h", "t"))
    rows += [(100, "http://other.example/1", "<body><div>Welcome to our site</div></body>", "h", "t"), (101, None, "<p>x</p>", None, None), (102, "nonsense", None, None, None), (0, "http://h.example/0", rows[0][2], "h", "t")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[k].text for k in range(12)] == texts
    assert (by[100].text, by[101].text, by[102].text, by[102].n_chars) == ("Welcome to our site", "x", "", 0)


def test_classes_are_ordered_and_nested():
    page = H.Page(tokens=[1, 2, 9, 3, 4, 8, 5])
    assert H.template_places(page, [[1, 2, 3, 4, 5]]) == {0, 1, 3, 4, 6}
    assert H.template_places(page, [[2, 1, 3]]) == set()  # another order
    assert H.template_places(page, [[1, 2, 3], [9, 4]]) == {0, 1, 3}  # crosses the larger one
    assert H.template_places(page, [[1, 5], [2, 3]]) == {0, 1, 3, 6}


def test_nesting_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        page = H.Page(tokens=[rng.randrange(8) for _ in range(rng.randrange(1, 14))])
        classes = [rng.sample(range(8), rng.randint(1, 4)) for _ in range(3)]
        spans, taken = [], set()
        for c in sorted(classes, key=lambda c: (-len(c), c)):
            places = [[k for k, t in enumerate(page.tokens) if t == x] for x in c]
            if len({len(p) for p in places}) != 1 or not places[0] or {k for p in places for k in p} & taken:
                continue
            rounds = list(zip(*places))
            flat = [k for r in rounds for k in r]
            if flat != sorted(flat) or any(a < x <= b < y or x < a <= y < b for a, *_, b in [(r[0], *r, r[-1]) for r in rounds] for x, y in spans):
                continue
            spans += [(r[0], r[-1]) for r in rounds]
            taken |= set(flat)
        # Classes of a host never share a token.
        if len({t for c in classes for t in c}) == sum(map(len, classes)):
            assert H.template_places(page, classes) == taken


def site(rng, words, hosts=4, pages=12):
    for h in range(hosts):
        for k in range(pages + h):
            body = "".join(f"<p>{' '.join(rng.choice(words) for _ in range(rng.randint(5, 30)))}</p>" for _ in range(rng.randint(1, 4)))
            menu = "".join(f'<a href="/{w}">{w}</a>' for w in rng.sample(words, rng.randint(2, 4)))
            yield f"http://h{h}.example/{k}", f"<body><div>{menu}</div><h2>Site {h}</h2><{('article', 'div')[h % 2]}><h1>{rng.choice(words)}</h1>{body}</{('article', 'div')[h % 2]}><p>All rights reserved</p></body>"


def test_templates_against_occurrence_vectors(spark, words):
    """Templates of hosts against classes of explicit vectors, with rows that are repeated."""
    rows = [(k, u, h, "h", "t") for k, (u, h) in enumerate(site(random.Random(8), words))]
    rows += rows[::5] + [(1000 + k, u + "/mirror", h, "h", "t") for k, u, h, *_ in rows[::7]]
    got = {r.host: r for r in H.templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    hosts = defaultdict(dict)
    for _, url, page, *_ in rows:
        hosts[H._host(url)].setdefault(H.evidence(H.parse(page))[0], H.parse(page))
    assert set(got) == set(hosts)
    for host, contents in hosts.items():
        pages = list(contents.values())
        vectors = defaultdict(set)
        for t in {t for p in pages for t in p.tokens}:
            vectors[tuple(Counter(p.tokens)[t] for p in pages)].add(t)
        texts = {r.token for p in pages for r in p.runs}
        want = {frozenset(c) for v, c in vectors.items() if sum(x > 0 for x in v) >= H.EVIDENCE and c & texts and c - texts}
        assert {frozenset(c) for c in got[host].classes} == want
        assert any(c & texts for c in want)


def test_templates_decide_the_text(spark, words):
    pages = list(site(random.Random(9), words))
    rows = [(k, u, h, "h", "t") for k, (u, h) in enumerate(pages)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (_, page) in enumerate(pages):
        inner = page[page.index("<h1>") : page.rindex("</article>" if "<article>" in page else "</div>")]
        assert got[k] == "\n\n".join(x for x in inner.replace("<p>", "").replace("<h1>", "").replace("</h1>", "</p>").split("</p>") if x)
        assert H.article(page, None) != got[k]


def test_marks_need_the_text_behind_them(spark, words):
    """Teasers in article tags are no article; a named wrapper or a form around everything is no reason to lose it."""
    body = [" ".join(words[k : k + 60]) for k in range(0, 300, 60)]
    rows = [(k, f"http://t.example/{k}", f"<body><div>{b}</div><article>more {k}</article></body>", "h", "t") for k, b in enumerate(body)]
    rows += [(10 + k, f"http://w.example/{k}", f'<body><div class="with-sidebar"><article>{b}</article></div><div class="sidebar">side {k}</div></body>', "h", "t") for k, b in enumerate(body)]
    rows += [(20 + k, f"http://f.example/{k}", f"<body><form><div>{b}</div></form></body>", "h", "t") for k, b in enumerate(body)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"{b}\n\nmore {k}" for k, b in enumerate(body)} | {10 + k: b for k, b in enumerate(body)} | {20 + k: b for k, b in enumerate(body)}


@pytest.mark.parametrize("page", ["<div>" * 100_000, '<a href="x' * 50_000 + "y", '<a x=">" ' * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<" * 300_000, "<p " + 'a="b" ' * 100_000 + ">x", "<p>" + "word " * 400_000])
def test_broken_and_long_pages_take_linear_time(page):
    began = time.time()
    alone(page)
    assert time.time() - began < 10


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("between", [" ", "\n", "&nbsp;", " <!-- x --> ", "<span hidden>x</span> ", " <span hidden>x</span>"])
def test_white_space_between_inline_tags(between):
    assert alone(f"<article><p><b>Hello</b>{between}<i>world</i></p>{between}<p><a>a</a><a>b</a></article>") == "Hello world\n\nab"


@pytest.mark.parametrize("tag", ["article", "main", "section"])
@pytest.mark.parametrize("copies", [2, 7, 8, 10])
def test_copies_of_one_article_stay(spark, words, tag, copies):
    body = " ".join(words[:30])
    other = [" ".join(words[k : k + 30]) for k in (40, 80)]
    page = "<html><body><div>Welcome to our site</div><{0}><h1>Title</h1><p>{1}</p></{0}><div>All rights reserved</div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(tag, t), "h", "t") for k, t in enumerate([body] * copies + other)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Without a mark, what all pages share goes: the greeting, the notice and the title that they have in common.
    assert got == {k: f"Title\n\n{t}" if tag != "section" else t for k, t in enumerate([body] * copies + other)}


def test_mirrors_alone_keep_their_text(spark, words):
    """A host of copies only, and one of rows that are repeated: nothing tells their article from a template, so it stays."""
    body = " ".join(words[:40])
    rows = [(k, f"http://m.example/{k}", f"<body><div>{body}</div><p>ad number {k}</p></body>", "h", "t") for k in range(10)]
    rows += [(50, "http://r.example/", f"<body><div>{body}</div></body>", "h", "t")] * 9
    for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text == (body if r.page_id == 50 else f"{body}\n\nad number {r.page_id}")


def _texts(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


MARKS = ["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<article id="{w}-{w}" class="{w}">{}</article>']


def test_a_word_that_changes_from_page_to_page(spark, words):
    """Menus and footers go however many pages a host has, though body's class and the article's id differ on each."""
    rng, rows, want = random.Random(4), [], {}
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    for pages in (1, 3, 100, 101, 1000):
        for m, mark in enumerate(MARKS):
            page = '<html><body class="p{w}"><nav>Menu words here</nav>' + mark.replace("{}", "<p>{t}</p>") + '<div class="comments">First!</div><footer>Copyright notice</footer></body></html>'
            for k in range(pages):
                want[len(rows)] = " ".join(rng.choice(words) for _ in range(20))
                rows.append((len(rows), f"http://h{pages}-{m}.example/{k}", page.format(w=name(k), t=want[len(rows)]), "h", "t"))
    assert _texts(spark, rows) == want


RARE = ["<div id=x{k}><nav>Menu words here</nav></div><section><article><p>{t}</p></article></section><footer>Copyright notice</footer>", '<nav>Menu words here</nav><div class="entry"><p>{t}</p></div><div class="footer">Copyright notice</div>']


def test_a_rare_second_layout(spark, words):
    rng, rows, want = random.Random(6), [], {}
    say = lambda: " ".join(rng.choice(words) for _ in range(20))
    for others in (0, 150, 300):
        for r, rare in enumerate(RARE):
            host = f"http://h{others}-{r}.example"
            for k in range(2):
                want[len(rows)] = say()
                rows.append((len(rows), f"{host}/odd{k}", f"<body>{rare.format(k=k, t=want[len(rows)])}</body>", "h", "t"))
            for k in range(others):
                want[len(rows)] = say()
                rows.append((len(rows), f"{host}/{k}", f"<body><nav>Menu words here</nav><main><p>{want[len(rows)]}</p></main><footer>Copyright notice</footer></body>", "h", "t"))
    assert _texts(spark, rows) == want


LAYOUTS = [
    "<article><p>{a}</p><section class='comments'><p>{c}</p></section></article>",
    "<main><article><p>{a}</p></article><section class='comments'><article>{c}</article><article>{c}</article></section></main>",
    "<div class='with-sidebar'><article><p>{a}</p></article></div><div id='comments'><article class='comment'>{c}</article></div>",
    "<main><p>{a}</p><ol class='comments'><li>{c}</li></ol></main>",
    "<div class='post'><p>{a}</p></div><div class='replies'>{c}</div>",
    "<main><div class='has-sidebar'><p>{a}</p></div></main>",
    "<form><main><div class='page-nav-left'><article><p>{a}</p><div class='reply'>{c}</div></article></div></main></form>",
]


def test_comments_longer_than_the_article(spark, words):
    rng, rows, want = random.Random(3), [], {}
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    for pages in (1, 30):
        for n in (10, 100, 400):
            for m, layout in enumerate(LAYOUTS):
                for k in range(pages):
                    want[len(rows)] = say(30)
                    rows.append((len(rows), f"http://h{pages}-{n}-{m}.example/{k}", f"<body>{layout.format(a=want[len(rows)], c=say(n))}</body>", "h", "t"))
    assert _texts(spark, rows) == want
