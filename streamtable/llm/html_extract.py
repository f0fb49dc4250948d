"""Main text of web pages: boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

Nodes are block elements and the runs of text between their edges. A node's class is whether its subtree holds main text. Trees give
each node a probability from its tag, attribute tokens, depth, subtree densities and siblings; the most probable labelling in which
no node with main text lies under one without is found exactly, bottom up. The model is trained on generated pages of many
layouts, whose main text is known by construction.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from streamtable.llm import _boosting
from streamtable.llm._store import small_batches

MARK = "data-main"  # tells the label of generated nodes
ROWS = 1 << 14  # nodes whose features are made at once
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template iframe head title select option button textarea datalist".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody")}
HOLDS = frozenset("ul ol menu dl table tr tbody thead tfoot article section main body div td th".split())
# Words in class, id, role and label attributes, by what they tell.
WORDS = {
    "main": "article post entry content main body story text prose page maincontent".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager toc tabs".split(),
    "edge": "header masthead footer foot colophon copyright legal topbar bottom branding logo banner contentinfo".split(),
    "side": "sidebar aside side rail widget related recommended trending popular more teaser tags complementary".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp affiliate".split(),
    "talk": "comment comments reply replies respond disqus discussion thread feedback reviews commentlist".split(),
    "note": "cookie cookies consent notice notification gdpr alert popup modal overlay toast message privacy subscribe newsletter signup paywall".split(),
    "tool": "share sharing social form search login toolbar buttons follow print skip hidden".split(),
}
KIND = {w: k for k, ws in enumerate(WORDS.values()) for w in ws}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "td", "table", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "#text"]
PLACES = ["article", "main", "nav", "header", "footer", "aside", "form", "p", "li"]


class Node:
    __slots__ = ("tag", "up", "depth", "kinds", "text", "links", "inline", "label")

    def __init__(self, tag: str, up: int, depth: int, kinds: int, label: bool):
        self.tag, self.up, self.depth, self.kinds, self.label = tag, up, depth, kinds, label
        self.text, self.links, self.inline = "", 0, 0


def attribute_kinds(raw: str) -> tuple[int, bool]:
    """The kinds of an element's attribute tokens, a bit each, the last bit for what is hidden; and whether MARK is there."""
    kinds, label = 0, False
    if raw.strip():
        for m in ATTRIBUTE.finditer(raw):
            name = m[1].lower()
            if name in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
                for w in PART.findall(m[2] or m[3] or m[4] or ""):
                    if (k := KIND.get(w.lower())) is not None:
                        kinds |= 1 << k
            elif name == "hidden" or name == "aria-hidden" and (m[2] or m[3] or m[4]) == "true" or name == "style" and "display:none" in (m[2] or m[3] or "").replace(" ", ""):
                kinds |= 1 << len(WORDS)
            elif name == MARK:
                label = True
    return kinds, label


class Tags:
    """Where the tags of a page begin and end. Every scan for an end either moves on to what it finds or is not made again, so a page takes linear time."""

    def __init__(self, page: str):
        self.page, self.missing, self.broken = page, set(), False

    def find(self, what: str, at: int) -> int:
        """page.find(), which remembers what is no longer there."""
        if what in self.missing:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def search(self, pattern: str, at: int):
        """The next match of a pattern in any case, remembered likewise."""
        if pattern in self.missing:
            return None
        m = re.compile(pattern, re.I).search(self.page, at)
        if m is None:
            self.missing.add(pattern)
        return m

    def end(self, at: int) -> int:
        """The place of the > that ends a tag. Quotes hide a > until a page turns out to have quotes that don't pair up. No > at all: the end of the page."""
        k = at
        while not self.broken:
            m = STOP.search(self.page, k)
            if m is None:
                self.broken = True
            elif m[0] == ">":
                return m.start()
            else:
                k = self.find(m[0], m.end()) + 1
                self.broken = k == 0
        k = self.find(">", at)
        return len(self.page) if k < 0 else k


def parse(page: str) -> list[Node]:
    """Block elements and text runs in page order. Unclosed and stray tags are mended the way browsers do in the usual cases."""
    nodes = [Node("html", -1, 0, 0, False)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, with their block's node
    where: dict[str, list[int]] = {"html": [0]}  # of each tag, its places in the stack
    parts: list[str] = []
    links = inline = 0
    at, n, tags = 0, len(page), Tags(page)

    def flush() -> None:
        nonlocal links, inline
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                up = stack[-1][1]
                node = Node("#text", up, nodes[up].depth + 1, 0, nodes[up].label)
                node.text, node.links, node.inline = text, min(links, len(text)), inline
                nodes.append(node)
        links = inline = 0

    def push(tag: str, node: int) -> None:
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def close(k: int) -> None:
        if any(t in BLOCK for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            where[t].pop()
        del stack[k:]

    def last(names) -> int:
        return max((where[t][-1] for t in names if where.get(t)), default=0)

    def find(names: tuple, stop: frozenset) -> int:
        """The innermost open element of names, 0 if there is none or one of stop is further in."""
        k = last(names)
        return k if k and last(stop - frozenset(names)) < k else 0

    while at < n:
        begin = page.find("<", at)
        end = n if begin < 0 else begin
        m = NAME.match(page, end + 2 if page.startswith("/", end + 1) else end + 1)
        closing = m is not None and m.start() == end + 2
        if end < n and m is None and page[end + 1 : end + 2] not in ("!", "?"):
            end += 1  # a bare <
        if end > at:
            parts.append(page[at:end])
            if where.get("a"):
                links += end - at
        if begin < 0:
            break
        if m is None:
            if end > begin:
                at = end
            elif page.startswith("<!--", begin):
                k = tags.find("-->", begin + 4)
                at = n if k < 0 else k + 3
            else:
                k = tags.find(">", begin)
                at = n if k < 0 else k + 1
            continue
        at = tags.end(m.end())
        tag, attributes = m[0].lower(), page[m.end() : at]
        at += 1
        if closing:
            if tag in SILENT or tag in ("html", "body"):
                continue
            if k := find((tag,), HOLDS if tag in ("p", "li") else frozenset()):
                close(k)
            continue
        if tag in SILENT:
            stop = tags.search(rf"</{tag}\b[^>]*>", at)
            if tag == "head" and (body := tags.search(r"<body\b|</head\b", at)):
                at = body.start()
            elif stop:
                at = stop.end()
            elif tag in ("script", "style", "textarea", "template"):
                at = n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in ("html", "body") and where.get(tag):
            continue
        if tag in BLOCK:
            if k := find(("p",), HOLDS):
                close(k)
            if tag in CLOSES and (k := find(CLOSES[tag], HOLDS - {"tr", "tbody", "thead", "tfoot", "td", "th"} if tag in ("tr", "td", "th") else HOLDS)):
                close(k)
            flush()
            kinds, label = attribute_kinds(attributes)
            up = stack[-1][1]
            nodes.append(Node(tag, up, nodes[up].depth + 1, kinds, label or nodes[up].label))
            if tag not in VOID:
                push(tag, len(nodes) - 1)
        elif tag not in VOID:
            inline += 1
            if not attributes.endswith("/"):
                push(tag, stack[-1][1])
    flush()
    return nodes


class Features:
    """What is known of each node; rows() makes the features of some of them, so that a page of a million nodes takes little memory."""

    def __init__(self, nodes: list[Node]):
        n = self.n = len(nodes)
        up = self.up = [x.up for x in nodes]
        own = np.zeros((n + 1, 6))
        for i, x in enumerate(nodes):
            own[i + 1] = (len(x.text), x.links, 1 + x.inline, x.text != "", sum(map(x.text.count, ".,;:!?")) if x.text else 0, x.tag == "p")
        end = list(range(1, n + 1))  # nodes are in page order, so a subtree is a run of them
        above, place, index, count, before, after = [x.kinds for x in nodes], [0] * n, [0] * n, [0] * n, [-1] * n, [-1] * n
        for i in range(n - 1, 0, -1):
            if end[i] > end[up[i]]:
                end[up[i]] = end[i]
        newest = [0] * n
        for i in range(1, n):
            u = up[i]
            above[i] |= above[u]
            place[i] = place[u] | (1 << PLACES.index(nodes[i].tag) if nodes[i].tag in PLACES else 0)
            index[i] = count[u]
            count[u] += 1
            if newest[u]:
                before[i], after[newest[u]] = newest[u], i
            newest[u] = i
        sums = np.cumsum(own, axis=0)
        self.sub = sums[end] - sums[:-1]
        self.parent = np.maximum(np.array(up), 0)
        self.own, self.above, self.place = (np.array(x, np.int32) for x in ([x.kinds for x in nodes], above, place))
        self.index, self.count, self.before, self.after = np.array(index), np.array(count)[self.parent], np.array(before), np.array(after)
        self.count[0] = 0
        self.tag = np.array([TAGS.index(x.tag) if x.tag in TAGS else len(TAGS) for x in nodes], np.int8)
        self.depth = np.array([x.depth for x in nodes])

    def rows(self, a: int, b: int) -> np.ndarray:
        text, links, tags, runs, marks, paragraphs = self.sub[a:b].T
        whole, up = self.sub[:, 0], self.parent[a:b]
        beside = [np.where(x[a:b] < 0, -1, np.log1p(whole[x[a:b]])) for x in (self.before, self.after)]
        bits = lambda x, k: (x[a:b, None] >> np.arange(k)) & 1
        return np.column_stack([
            self.depth[a:b], np.log1p(text), links / (text + 1), tags / (text + 1) * 100, text / (runs + 1), marks / (text + 1) * 100, np.log1p(runs), np.log1p(paragraphs), text / max(whole[0], 1.0), text / (whole[up] + 1),
            self.index[a:b], self.count[a:b], self.index[a:b] / np.maximum(self.count[a:b], 1), *beside, np.log1p(whole[up]), self.sub[up, 1] / (whole[up] + 1), np.arange(a, b) / self.n,
            self.tag[a:b, None] == np.arange(len(TAGS)), bits(self.own, len(WORDS) + 1), bits(self.above, len(WORDS) + 1), bits(self.place, len(PLACES))])


def features(nodes: list[Node]) -> np.ndarray:
    return Features(nodes).rows(0, len(nodes))


def decode(p: np.ndarray, up) -> np.ndarray:
    """The most probable labelling in which a node with main text has no ancestor without."""
    up = np.asarray(up).tolist()
    best = np.log(np.clip(p, 1e-6, 1)).tolist()  # of the subtree, its root with main text
    none = np.log(np.clip(1 - p, 1e-6, 1)).tolist()  # of the subtree without any
    for i in range(len(up) - 1, 0, -1):
        none[up[i]] += none[i]
        best[up[i]] += max(best[i], none[i])
    out = [best[0] > none[0]]
    for i in range(1, len(up)):
        out.append(out[up[i]] and best[i] > none[i])
    return np.array(out)


def generated_page(r: random.Random) -> str:
    """A page of a random layout, the blocks of its main text marked with MARK."""
    syllables = [a + b for a in "b d f g k l m n p r s t v ch th st".split() for b in "a e i o u an er in on".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def sentence(n: int) -> str:
        ws = [word() for _ in range(n)]
        if r.random() < 0.1:
            ws = [w + r.choice(("/", " -", "!", "*", ")", "&amp;", " &gt;", "|")) for w in ws]
        if n > 6 and r.random() < 0.5:
            ws[n // 2] += ","
        return " ".join(ws).capitalize() + r.choice((".", ".", ".", "", "?"))

    def prose(most: int = 8) -> str:
        return " ".join(sentence(r.choice((1, 2, 4, 7, 10, 14, 18))) for _ in range(r.choice((1, 1, 2, 3, 5, most))))

    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.choice((1, 1, 2, 3))))}</a>'

    def named(tag: str, kinds: tuple, body: str, sure: bool = False) -> str:
        a = ""
        if sure or r.random() < 0.7:
            ws = [r.choice(WORDS[r.choice(kinds)])]
            if r.random() < 0.3:
                ws.append(r.choice((word(), "box", "wrap", "inner", "block", "top", "col-4")))
            a = f' {r.choice(("class", "class", "id"))}="{r.choice(("-", " ", "_")).join(ws)}"'
        return f"<{tag}{a}>{body}</{tag}>"

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) if r.random() < 0.8 else ""
        body = f"<ul>{items}</ul>" if items else " ".join(link() for _ in range(r.randint(2, 8)))
        return named("nav", ("menu",), body) if r.random() < 0.6 else named("div", ("menu",), body, True)

    def header() -> str:
        return named(*((("header", ("edge",))) if r.random() < 0.5 else ("div", ("edge",))), r.choice((f"<h1>{sentence(3)}</h1>", f"<p>{sentence(5)}</p>", link(), sentence(4))) + (menu() if r.random() < 0.4 else ""), True)

    def footer() -> str:
        body = r.choice(("&copy; ", "", "(c) ")) + f"{r.choice((word(), f'{word()} {word()}', f'www.{word()}.org'))} {r.choice(('&middot;', '|', '-', ''))} {prose(2)}" + " ".join(link() for _ in range(r.randint(0, 5)))
        return named("footer", ("edge",), f"<p>{body}</p>" if r.random() < 0.4 else body) if r.random() < 0.7 else named("div", ("edge",), body, True)

    def side() -> str:
        body = "".join(r.choice((f"<h3>{sentence(3)}</h3>", f"<p>{prose(3)}</p>", f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randint(2, 6)))}</ul>", f"<div>{link()} {sentence(6)}</div>")) for _ in range(r.randint(1, 5)))
        return named("aside", ("side",), body) if r.random() < 0.6 else named("div", ("side",), body, True)

    def advert() -> str:
        return named(r.choice(("div", "div", "section", "aside", "p")), ("ad",), r.choice((prose(3), f"<p>{prose(2)}</p>", f"{link()} {sentence(5)}")), True)

    def notice() -> str:
        return named(r.choice(("div", "div", "section", "p")), ("note",), r.choice((prose(3), f"<p>{prose(2)}</p>{link()}", f"<p>{sentence(12)}</p><button>{word()}</button>")), True)

    def form() -> str:
        body = "".join(f"<label>{sentence(2)}</label><input name=x>" for _ in range(r.randint(1, 4))) + f"<button>{word()}</button>" + (f"<p>{sentence(9)}</p>" if r.random() < 0.5 else "")
        return named("form", ("tool", "note"), body) if r.random() < 0.8 else named("div", ("tool",), f"<form>{body}</form>", True)

    def talk() -> str:
        one = lambda: named(r.choice(("div", "li", "article")), ("talk",), r.choice((f"<h4>{word()}</h4>", f"<b>{word()}</b>", f"<span>{word()}</span>", "")) + f"<p>{prose(4)}</p>")
        body = f"<h3>{r.choice(('Comments', 'Replies', sentence(2)))}</h3>" + "".join(one() for _ in range(r.randint(1, 6))) + (form() if r.random() < 0.4 else "")
        return named(r.choice(("section", "div", "ul", "ol")), ("talk",), body, True)

    def share() -> str:
        return named(r.choice(("div", "ul", "p")), ("tool",), " ".join(link() for _ in range(r.randint(2, 5))), True)

    odd = [advert, advert, notice, share, form, side]
    mark = f" {MARK}"
    blocks = []
    if r.random() < 0.8:
        title = f"<h1{mark}>{sentence(r.randint(1, 9))}</h1>"
        blocks.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
    for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))):
        kind = r.random()
        if kind < 0.72:
            body = prose(12)
            if r.random() < 0.2:
                tag = r.choice(("b", "i", "em", "strong", "span", "small", "code"))
                body = r.choice((f"<{tag}>{body}{r.choice((f'</{tag}>', ''))}", f"{body}<br>{sentence(6)}", f"{body} {link()} {sentence(4)}", f"<{tag}>{sentence(3)}</{tag}> {body}"))
            blocks.append(f"<p{mark}>{body}" + ("</p>" if r.random() < 0.9 else ""))
        elif kind < 0.8:
            blocks.append(f"<h2{mark}>{sentence(4)}</h2>")
        elif kind < 0.87:
            blocks.append(f"<ul{mark}>{''.join(f'<li>{prose(2)}</li>' for _ in range(r.randint(1, 5)))}</ul>")
        elif kind < 0.91:
            blocks.append(f"<blockquote{mark}><p>{prose(3)}</p></blockquote>")
        elif kind < 0.94:
            blocks.append(f"<pre{mark}>{prose(3)}</pre>")
        elif kind < 0.97:
            blocks.append(f"<div{mark}>{prose(4)}</div>")
        else:
            blocks.append(f"<table{mark}><tr>{''.join(f'<td>{sentence(2)}</td>' for _ in range(3))}</tr></table>")
    if not blocks:
        blocks.append(f"<p{mark}>{prose(4)}</p>")
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        blocks.insert(r.randint(0, len(blocks)), r.choice(odd)())
    inner = "".join(blocks)
    shape = r.random()
    if shape < 0.45:
        main = f"<article>{inner}</article>"
    elif shape < 0.6:
        main = named("article", ("main",), inner)
    elif shape < 0.7:
        main = named("main", ("main",), inner)
    elif shape < 0.95:
        main = named(r.choice(("div", "section", "div")), ("main",), inner, True)
    else:
        main = inner
    if r.random() < 0.25:
        main = f"<main>{main}{r.choice(('', '', talk(), side()))}</main>"
    elif r.random() < 0.25:
        main = named("div", ("main",), main + r.choice(("", talk(), side(), share())))
    before = [f() for f in r.sample([menu, header, advert, notice, side, share, form], r.randint(0, 4))]
    after = [f() for f in r.sample([talk, side, advert, notice, form, share, menu], r.randint(0, 4))] + ([footer()] if r.random() < 0.85 else [])
    return f"<!DOCTYPE html><html><head><title>{sentence(3)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def train(pages: int = 500, seed: int = 5) -> _boosting.Trees:
    """The model, trained on so many generated pages."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(generated_page(r))
        has = np.array([x.label for x in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            has[nodes[i].up] |= has[i]
        xs.append(features(nodes))
        ys.append(has)
    return _boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(pages: list[str | None], model: _boosting.Trees) -> list[str]:
    """The main text of each page: kept runs of text in page order, joined by a blank line."""
    parsed = [parse(p or "") for p in pages]
    told = [Features(nodes) for nodes in parsed]
    jobs, held = [], 0  # runs of nodes whose probabilities are found together
    for k, f in enumerate(told):
        for a in range(0, f.n, ROWS):
            if not jobs or held + min(ROWS, f.n - a) > ROWS:
                jobs.append([])
                held = 0
            jobs[-1].append((k, a, min(a + ROWS, f.n)))
            held += jobs[-1][-1][2] - a
    p = [np.zeros(f.n) for f in told]
    for job in jobs:
        found, at = model.probabilities(np.concatenate([told[k].rows(a, b) for k, a, b in job])), 0
        for k, a, b in job:
            p[k][a:b] = found[at : at + b - a]
            at += b - a
    return ["\n\n".join([x.text for x, k in zip(nodes, decode(q, f.up).tolist(), strict=True) if k and x.text]) for nodes, q, f in zip(parsed, p, told, strict=True)]


def extract(pages: DataFrame, html_col: str = "html", model: _boosting.Trees | None = None) -> DataFrame:
    """pages without html_col, with text and n_chars (code points), which take the place of columns of those names.

    Null and empty pages: "". White space of any kind inside a block is one space; br separates words. Each page is read whole and alone:
    repeated rows, ties and very long pages are nothing special. Empty table: empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    model = model or train()
    shared = spark.sparkContext.broadcast((model.edges, model.base, model.feature, model.cut, model.value))
    keep = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]

    def run(batches):
        own = _boosting.Trees(*shared.value)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            texts = [t for a in range(0, len(raw), 16) for t in main_text(raw[a : a + 16], own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"c{k}" for k in range(len(keep))), "text", "n_chars"])

    schema = StructType([*(StructField(f"c{k}", pages.schema[c].dataType) for k, c in enumerate(keep)), *StructType.fromDDL("text string, n_chars bigint").fields])
    given = pages.select(F.col(html_col).alias("h"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)))
    return given.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
