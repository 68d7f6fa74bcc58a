"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags with their paths, and its text runs with theirs. Over the distinct
contents of a host, tokens with the same occurrence vector (so many times on each page) form an
equivalence class. Vectors are never gathered: a token's vector is a XOR of hashes of (content,
count), so classes come from grouped aggregations, and pages with the same text count once, however
often rows or mirrors repeat them. Tags nest by construction; runs of text belong to the template if their class
has tags too, if EVIDENCE contents and a SHARE of them at least hold it and if its tokens stand in the
class's order on the page. Paths are those of names alone, so ids and classes that change from page to page
change no token but their own element's, and that one only by the words that say something about articles.

What the template doesn't hold is slots. What names of elements and words of their classes say counts on
their own page, whatever other pages a host has; the host's pages that have the same thing may overrule it.
A kind of mark (article, main, content) counts if it covers MARKED of the running text of the pages that have it, so
teasers in article tags don't. An element whose words say that it holds no article counts all the same if on most of
the pages that have it the first mark lies in it, with half of the marked text, or if it is only the layout of all that is
marked; nothing within an article's mark does, nor do comments that stand behind it, however long they are. Text that the
template holds, and blocks of links, are no data where no mark counts. Within a mark that counts no text goes because others
have it too: pages may be copies of one article or share paragraphs. Without a template (`article(page, None)`) a page is
one slot: all its text.

Cases: null or empty html gives an empty text. A page whose url is null or has no host is a host of
its own. Repeated rows give repeated results, ties none. An empty table gives none. Other columns
are never read. Long, deeply nested and broken pages take time in proportion to their length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: Least share of a host's contents that a text of the template is on, so that a template is no longer than 100 average pages. It decides on pages without marks only.
SHARE = 0.01
#: Contents that must agree before a text is the template's; two can't tell a template from a quotation.
EVIDENCE = 3
#: Least share of the running text that a kind of mark covers on the pages that have it; least share of it that a form holds which is no form but the page.
MARKED, WHOLE = 0.25, 0.9

# Names of elements and words of class, id and role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
APART = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "audio", "video", "canvas", "label", "fieldset", "datalist"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = {"td", "th", "br"}
CLOSES_P = BLOCKS - {"html", "body"}
NOT_ARTICLE = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar sidenav aside widget ad ads adv advert adverts advertisement adsbygoogle "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments disqus reply replies respond responses discussion pagination pager "
    "login search toolbar skip".split()
)
NOT_ARTICLE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
ARTICLE_WORDS = {"article", "post", "entry", "content", "main", "story"}
TALK_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond", "responses", "discussion"}
LAYOUT_WORDS = {"sidebar", "sidenav", "nav", "navbar", "menu", "toolbar", "banner"}

#: What an element's name, words and attributes say about it: no article, perhaps none, a form; a mark of each kind; a link; readers' talk; layout alone.
APART_BIT, PERHAPS, FORM, ARTICLE, MAIN, CONTENT, LINK = 1, 2, 4, 8, 16, 32, 64
TALK, LAYOUT = 256, 512
KINDS = (ARTICLE, MAIN, CONTENT)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ENDS = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_closes: dict[str, re.Pattern] = {}
_tags: dict[str, tuple[str, str, int, frozenset]] = {}


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Run:
    """A run of text: its place among the page's tokens, its node and its block; size counts its characters without outer white space."""

    place: int
    token: int
    text: str
    size: int
    block: int
    node: int


@dataclass
class Page:
    """Nodes are elements in page order; -1 is the page itself. path: a hash of the names down to the node. bits: of the node and all that it stands in."""

    tokens: list[int] = field(default_factory=list)  # of tags and text runs, in page order
    node_token: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)


def _told(raw: str) -> tuple[str, str, int, frozenset]:
    """Name of an opening tag, what its token adds to the path it stands in, its bits, and its words; remembered, since tags repeat."""
    if (known := _tags.get(raw)) is not None:
        return known
    name = _NAME.match(raw)[0]
    rest, name = raw[len(name) :], name.lower()
    attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(rest)} if rest.strip() else {}
    words = frozenset(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    role = attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    bits = ARTICLE * (name == "article") | MAIN * (name == "main" or role == "main") | LINK * (name == "a")
    bits |= CONTENT * (bool(words & ARTICLE_WORDS) and name not in ("html", "body"))
    bits |= FORM * (name == "form") | APART_BIT * ((name in APART and name != "form") or hidden or role in NOT_ARTICLE_ROLES)
    # The whole page and the article itself may say what they contain; an article of comments only says that.
    bits |= PERHAPS * (bool(words & NOT_ARTICLE) and not (name in ("html", "body", "main") or name == "article" and words & ARTICLE_WORDS))
    if bits & PERHAPS:
        said = words & NOT_ARTICLE
        bits |= TALK * bool(said & TALK_WORDS) | LAYOUT * (said <= LAYOUT_WORDS)
    path = "/" + name + "".join(f".{w}" for w in sorted(words & (NOT_ARTICLE | ARTICLE_WORDS))) + "!" * hidden + (f"@{role}" if role in NOT_ARTICLE_ROLES or role == "main" else "")
    if len(_tags) > 50_000:
        _tags.clear()
    _tags[raw] = name, path, bits, words
    return _tags[raw]


def parse(page: str) -> Page:
    """Nodes and runs of a page, in one pass over it."""
    out, stack, open_names, block, gap = Page(), [], Counter(), 0, -1
    last_quote = {q: page.rfind(q) for q in "\"'"}
    quotes = True  # whether quotes may hide a >; not any more, once a tag wouldn't end because of them

    def text(s: str) -> None:
        nonlocal gap
        plain = s if s.isspace() else entities.unescape(s)
        if clean := " ".join(plain.split()):
            node = stack[-1][1] if stack else -1
            out.tokens.append(_hash(f"{out.path[node] if node >= 0 else 0:x}\0{clean}"))
            out.runs.append(Run(len(out.tokens) - 1, out.tokens[-1], " " * (gap == block) + plain, len(clean), block, node))
            gap = -1
        elif plain:
            # White space alone parts the runs on both sides; either may be left out later.
            gap = block
            if out.runs and out.runs[-1].block == block:
                out.runs[-1].text += " "

    def pop(name: str) -> None:
        while True:
            top = stack.pop()[0]
            open_names[top] -= 1
            if top == name:
                return

    def tag_end(at: int) -> int:
        nonlocal quotes
        first = at
        while quotes and (m := _ENDS.search(page, at)):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if page[m.start() - 1] == "=" or page[m.start() - 1].isspace():
                at = page.index(m[0], at) + 1 if last_quote[m[0]] >= at else at
        quotes = False
        return page.find(">", first)

    begin = at = 0
    while (lt := page.find("<", at)) >= 0:
        at = lt + 1
        mark = page[at : at + 1]
        if mark in ("!", "?"):
            end = page.find("-->", lt + 4) if page.startswith("!--", at) else page.find(">", at)
            if end < 0 and not page.startswith("!--", at):
                continue
            text(page[begin:lt])
            begin = at = len(page) if end < 0 else end + (3 if page.startswith("!--", lt + 1) else 1)
            continue
        closing = mark == "/"
        m = _NAME.match(page, at + closing)
        if not m:
            continue
        end = page.find(">", m.end()) if closing else tag_end(m.end())
        if end < 0:
            continue
        text(page[begin:lt])
        begin = at = end + 1
        if closing:
            name = m[0].lower()
        else:
            raw = page[lt + 1 : end]
            name, path, bits, words = _told(raw)
        if name in BLOCKS:
            block += 1
        elif name in CELLS and out.runs and out.runs[-1].block == block:
            out.runs[-1].text += " "
        if closing:
            if open_names[name]:
                pop(name)
            continue
        if name in RAW:
            if not raw.endswith("/"):
                if name not in _closes:
                    _closes[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)
                close = _closes[name].search(page, at)
                end = page.find(">", close.end()) if close else -1
                begin = at = len(page) if end < 0 else end + 1
            continue
        if name in CLOSES_P and open_names["p"]:
            pop("p")
        if name == "li" and stack and stack[-1][0] == "li":
            pop("li")
        node = stack[-1][1] if stack else -1
        inside = out.bits[node] if node >= 0 else 0
        if (name == "header" or ("header" in words and not words & ARTICLE_WORDS)) and not inside & ARTICLE:
            bits |= APART_BIT
        around = out.path[node] if node >= 0 else 0
        token = _hash(f"{around:x}{path}")
        out.path.append(_hash(f"{around:x}/{name}"))
        out.tokens.append(token)
        out.place.append(len(out.tokens) - 1)
        out.node_token.append(token)
        out.parent.append(node)
        out.own.append(bits)
        out.bits.append(inside | bits)
        if name not in VOID:
            stack.append((name, len(out.parent) - 1))
            open_names[name] += 1
    text(page[begin:])
    return out


# --- evidence -----------------------------------------------------------------------------------

#: Tokens that carry a host's sums: all running text, and that of each kind.
_TOTAL = _hash("\0total")
_OF_KIND = {k: _hash(f"\0kind{k}") for k in KINDS}
_SEEN = "array<struct<token:long,vec:long,at:long,chars:long,whole:long,holds:int,bits:int>>"
_NAMES = ["token", "vec", "at", "chars", "whole", "holds", "bits"]
TEXT_BIT = 128


def _upwards(page: Page, own: list[int], stop: set[int] = frozenset()) -> list[int]:
    """Sums over each node and what stands in it; nodes of stop give nothing to the one they stand in."""
    out = list(own)
    for k in range(len(page.parent) - 1, -1, -1):
        if (up := page.parent[k]) >= 0 and k not in stop:
            out[up] += out[k]
    return out


def holders(page: Page) -> set[int]:
    """Nodes whose words or name say that they hold no article, while on this page they do."""
    doubted = [k for k, own in enumerate(page.own) if own & (PERHAPS | FORM)]
    if not doubted:
        return set()
    own = [0] * len(page.parent)
    for r in page.runs:
        if r.node >= 0 and not page.bits[r.node] & (LINK | APART_BIT):
            own[r.node] += r.size
    chars, total = _upwards(page, own), sum(own)
    inside = [0] * len(page.parent)  # bits of the elements around each node
    for k, up in enumerate(page.parent):
        inside[k] = page.bits[up] if up >= 0 else 0
    # Marks: articles that aren't readers' talk; if there are none, what is main; else the one article that holds almost all.
    marks = [k for k, o in enumerate(page.own) if o & ARTICLE and not o & (PERHAPS | APART_BIT) and not inside[k] & (TALK | ARTICLE)]
    marks = marks or [k for k, o in enumerate(page.own) if o & MAIN and not o & (PERHAPS | APART_BIT) and not inside[k] & MAIN]
    if not marks:
        articles = [k for k, o in enumerate(page.own) if o & ARTICLE and not inside[k] & ARTICLE]
        marks = articles if len(articles) == 1 and chars[articles[0]] >= WHOLE * total > 0 else []
    marks = [k for k in marks if chars[k]]
    marked = [0] * len(page.parent)
    for k in marks:
        marked[k] = chars[k]
    below, all_marked = _upwards(page, marked), sum(marked)
    ahead = set()
    k = marks[0] if marks else -1
    while k >= 0 and (k := page.parent[k]) >= 0:
        ahead.add(k)
    within = set(marks)
    for k, up in enumerate(page.parent):
        if up in within:
            within.add(k)
    out = set()
    for k in doubted:
        bits = page.own[k]
        if bits & PERHAPS and k not in within and k in ahead and below[k] * 2 >= all_marked > 0:
            out.add(k)
        elif bits & PERHAPS and bits & LAYOUT and k in within and not inside[k] & ARTICLE and chars[k] >= WHOLE * all_marked > 0:
            out.add(k)
        elif bits & FORM and (chars[k] >= WHOLE * total > 0 or (k in ahead and below[k] * 2 >= all_marked > 0)):
            out.add(k)
    return out


def evidence(page: Page) -> tuple[int, list[tuple]]:
    """A hash of the page's text, and for each of its tokens: token, vec (a hash of content and count), at (its first place), chars (characters of running
    text in it), whole (those that a kind is held against), holds (whether it is one of `holders`), bits."""
    content = _hash("\n".join(r.text.strip() for r in page.runs))
    kept, bits = holders(page), [0] * len(page.parent)
    for k, up in enumerate(page.parent):
        bits[k] = (page.own[k] & ~(PERHAPS | FORM) if k in kept else page.own[k]) | (bits[up] if up >= 0 else 0)
    total, of_kind = 0, dict.fromkeys(KINDS, 0)
    for r in page.runs:
        around = bits[r.node] if r.node >= 0 else 0
        if around & (LINK | APART_BIT | PERHAPS | FORM):
            continue
        total += r.size
        for kind in KINDS:
            of_kind[kind] += r.size * bool(around & kind)
    found: dict[int, list[int]] = {}  # token -> count, place, chars, holds, bits
    for k, token in enumerate(page.node_token):
        own = found.setdefault(token, [0, page.place[k], 0, 0, page.own[k]])
        own[0] += 1
        own[3] |= k in kept
    for r in page.runs:
        apart = bool(page.bits[r.node] & (APART_BIT | PERHAPS | LINK)) if r.node >= 0 else False
        own = found.setdefault(r.token, [0, r.place, 0 if apart else r.size, 0, TEXT_BIT])
        own[0] += 1
    rows = [(t, _hash(f"{content}\0{n}"), at, c, 0, int(holds), b) for t, (n, at, c, holds, b) in found.items()]
    sums = [(_OF_KIND[k], n) for k, n in of_kind.items() if n]
    return content, rows + [(t, content, -1, n, total, 0, 0) for t, n in [(_TOTAL, total), *sums]]


@dataclass
class Template:
    """kept: tokens of elements that hold the article whatever their names say. kinds: bits of the marks that count. classes: tokens in order, of classes with text."""

    kept: set[int]
    kinds: int
    classes: list[list[int]]


def conclude(rows: Iterable[tuple]) -> Template:
    """The template of a host from its tokens: token, contents that have it, vec, at (mean place), chars, whole, holds, bits (chars, whole and holds are sums over contents)."""
    by = {r[0]: r for r in rows}
    total = by[_TOTAL][4]
    kept = {r[0] for r in by.values() if r[7] & (PERHAPS | FORM) and r[6] * 2 >= r[1]}
    kinds = sum(k for k, t in _OF_KIND.items() if t in by and by[t][4] >= MARKED * by[t][5])
    contents = by[_TOTAL][1]
    for t in (_TOTAL, *_OF_KIND.values()):
        by.pop(t, None)
    classes: dict[tuple[int, int], list[tuple]] = {}
    for r in by.values():
        if r[1] >= max(EVIDENCE, SHARE * contents):
            classes.setdefault((r[1], r[2]), []).append(r)
    fixed = [sorted(c, key=lambda r: (r[3], r[0])) for c in classes.values() if any(r[7] & TEXT_BIT for r in c) and any(not r[7] & TEXT_BIT for r in c)]
    # Text that outweighs the rest is what copies share, no template.
    if sum(r[4] for c in fixed for r in c if r[7] & TEXT_BIT) * 2 > total:
        fixed = []
    return Template(kept, kinds, [[r[0] for r in c] for c in fixed])


def alone(page: Page) -> Template:
    """The template of a host with one page."""
    return conclude((t, 1, vec, at, chars, whole, holds, bits) for t, vec, at, chars, whole, holds, bits in evidence(page)[1])


# --- slots --------------------------------------------------------------------------------------


def template_places(page: Page, classes: list[list[int]]) -> set[int]:
    """Places of the page's tokens that belong to valid, nested classes (each its tokens in order), largest first."""
    where: dict[int, list[int]] = {t: [] for c in classes for t in c}
    for k, t in enumerate(page.tokens):
        if t in where:
            where[t].append(k)
    taken: set[int] = set()
    inside = [0] * len(page.tokens)  # the innermost accepted span that each place lies in
    spans = 0
    for tokens in sorted(classes, key=lambda c: (-len(c), c)):
        places = [where[t] for t in tokens]
        times = {len(p) for p in places}
        if len(times) != 1 or not times.pop():
            continue
        rounds = list(zip(*places))
        flat = [k for one in rounds for k in one]
        # Spans are nested or apart if both ends lie in the same innermost span.
        if any(a > b for a, b in zip(flat, flat[1:])) or any(inside[one[0]] != inside[one[-1]] for one in rounds):
            continue
        for one in rounds:
            spans += 1
            around = inside[one[0]]
            for k in range(one[0], one[-1] + 1):
                if inside[k] == around:
                    inside[k] = spans
        taken.update(flat)
    return taken


def article(page: str | Page, template: Template | None) -> str:
    """The text of the page's data slots; without a template the whole page is one slot."""
    page = parse(page) if isinstance(page, str) else page
    chosen = page.runs
    if template is not None:
        # Bits of the elements that each node stands in: no article, and marks that count.
        bits = [0] * len(page.parent)
        for k, token in enumerate(page.node_token):
            own, up = page.own[k], page.parent[k]
            if token in template.kept:
                own &= ~(PERHAPS | FORM)
            bits[k] = own | (bits[up] if up >= 0 else 0)
        state = lambda r: bits[r.node] if r.node >= 0 else 0
        runs = [r for r in page.runs if not state(r) & (APART_BIT | PERHAPS | FORM)]
        for kind in KINDS:
            if template.kinds & kind and (chosen := [r for r in runs if state(r) & kind]):
                break
        else:
            kind, chosen = 0, runs
        if kind in (0, CONTENT):
            fixed = template_places(page, template.classes) if template.classes else set()
            chosen = [r for r in chosen if r.place not in fixed]
        if not kind:
            share: Counter = Counter()
            for r in chosen:
                share[r.block] += r.size if state(r) & LINK else -r.size
            chosen = [r for r in chosen if share[r.block] <= 0]
    blocks: dict[int, list[str]] = {}
    for r in chosen:
        blocks.setdefault(r.block, []).append(r.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


# --- plan ---------------------------------------------------------------------------------------


def _host(url: str | None) -> int | None:
    m = _HOST.match(url or "")
    return _hash(m[1].lower()) if m else None


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, content, tokens: one row for each page that has a host."""
    fields = [pa.field(n, pa.int32() if n in ("holds", "bits") else pa.int64()) for n in _NAMES]
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            rows = batch.slice(first, 200)
            hosts, contents, cuts, cols = [], [], [0], [[] for _ in fields]
            for url, page in zip(rows.column(0), rows.column(1)):
                if (host := _host(url.as_py())) is None or not (page := page.as_py()):
                    continue
                content, own = evidence(parse(page))
                hosts.append(host)
                contents.append(content)
                for c, x in zip(cols, zip(*own)):
                    c.extend(x)
                cuts.append(len(cols[0]))
            tokens = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=fields)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(contents, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tokens)], ["host", "content", "tokens"])


_TEMPLATE = "host long, kept array<long>, kinds int, classes array<array<long>>"


def _concluded(group: pa.Table) -> pa.Table:
    rows = group.to_pydict()
    t = conclude(zip(*(rows[c] for c in ("token", "pages", "vec", "at", "chars", "whole", "holds", "bits"))))
    longs = pa.list_(pa.int64())
    return pa.table(
        {
            "host": pa.array(rows["host"][:1], pa.int64()), "kept": pa.array([sorted(t.kept)], longs),
            "kinds": pa.array([t.kinds], pa.int32()), "classes": pa.array([t.classes], pa.list_(longs)),
        }
    )


def templates(pages: DataFrame) -> DataFrame:
    """host and its template. Rows of one content count once; a host's tokens meet in one task only after SHARE has bounded those of its texts, and the vote of their pages the others."""
    seen = pages.select("url", "html").mapInArrow(_evidence, f"host long, content long, tokens {_SEEN}")
    once = seen.dropDuplicates(["host", "content"])
    tokens = once.select("host", F.inline("tokens")).groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor("vec").alias("vec"), F.avg("at").alias("at"), F.sum("chars").alias("chars"), F.sum("whole").alias("whole"), F.sum("holds").alias("holds"), F.first("bits").alias("bits")
    )
    voted = (F.col("bits").bitwiseAND(PERHAPS | FORM) != 0) & (F.col("holds") * 2 >= F.col("pages"))
    sums = F.col("token").isin(_TOTAL, *_OF_KIND.values())
    tokens, path = written(tokens.where((F.col("pages") >= EVIDENCE) | voted | sums), "tokens")
    contents = tokens.where(F.col("token") == _TOTAL).select("host", F.col("pages").alias("contents"))
    chosen = tokens.join(contents, "host").where(voted | sums | (F.col("pages") >= F.greatest(F.lit(EVIDENCE), SHARE * F.col("contents")))).drop("contents")
    found, _ = written(chosen.groupBy("host").applyInArrow(_concluded, _TEMPLATE), "templates")
    remove(pages.sparkSession, path)
    return found


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, Template] = {}
    for batch in batches:
        for first in range(0, batch.num_rows, 100):
            part = batch.slice(first, 100)
            host, kinds = part.column(3).to_pylist(), part.column(5)
            texts = []
            for k, html in enumerate(part.column(2)):
                page = parse(html.as_py() or "")
                if not kinds[k].is_valid:
                    template = alone(page)
                elif (template := known.get(host[k])) is None:
                    if len(known) > 2000:
                        known.clear()
                    template = known[host[k]] = Template(set(part.column(4)[k].as_py()), kinds[k].as_py(), part.column(6)[k].as_py())
                texts.append(article(page, template))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([_host(u) for u in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), hosts], ["page_id", "url", "html", "host"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = templates(pages)  # as a table, its size is known when the join is planned
    hosted = pages.mapInArrow(_with_host, "page_id long, url string, html string, host long")
    joined = hosted.join(found, "host", "left").select("page_id", "url", "html", "host", "kept", "kinds", "classes")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
