"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of its block elements, with a leaf for each run of text (a block). Every node has a label, content or not. Its
unary potential comes from its tag, class and id words, lengths, links and place; a potential on each edge ties a child to
its parent. Messages go up from the leaves and down from the root (sum-product, exact on a tree) and give each node's content
marginal; blocks of at least 0.5 are the text.

Weights are trained by conditional likelihood (the gradient is what labels show minus what the marginals expect) on labelled pages:

* a sample of the given pages, bounded by `SAMPLE_PAGES` and to those with one article element and at most `SAMPLE_BLOCKS` blocks, whose
  markup labels the blocks: inside the article and not in a menu, form, comment or the like;
* `LAYOUTS` other layouts of each sampled page's texts, and of filler texts where there are no such pages, whose labels are known as they are
  laid out: without telling tags, with sidebars, notices, adverts, forms and readers' comments inside the article, and so on.

Pages are parsed on executors and scored many at a time in arrays; nothing but the sampled trees' numbers reaches the driver.

Text inside a block: character references are decoded, white space becomes one space, ends are trimmed; inline tags leave no trace and
`<br>` is white space. Scripts, styles, comments, the head, and what browsers don't show as text (templates, drawings, players, choices) are
never text. Unclosed, misnested and cut-off markup is read as browsers do in the common cases.

Edge cases: a null or empty html has the empty text and 0 characters; a page without content blocks too; repeated rows each get a row; null ids and
urls are kept; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_BLOCKS, LAYOUTS, FILLER_PAGES = 200, 400, 2, 150
STEPS, RATE, RIDGE = 120, 0.15, 1e-4
#: Nodes scored at once.
NODES_AT_ONCE = 20_000

#: Kinds of nodes by tag; other tags are "div", runs of text "text".
KINDS = (
    "text", "body", "div", "article", "main", "section", "p", "heading", "list", "li", "table", "cell", "pre", "blockquote", "figure",
    "nav", "header", "footer", "aside", "form", "details", "dialog", "address",
)
KIND_OF = {k: k for k in KINDS} | {f"h{i}": "heading" for i in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dt": "li", "dd": "li"}
KIND_OF |= {"tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "td": "cell", "th": "cell", "caption": "cell", "figcaption": "figure", "fieldset": "form", "search": "form", "summary": "details"}

#: Groups of words in class, id and role; a word of four letters or more also counts as the beginning of a longer one.
HINTS = {
    "content": ("content", "article", "post", "entry", "story", "text", "body", "main", "prose", "blog"),
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"),
    "head": ("header", "masthead", "topbar", "logo", "branding", "hero"),
    "foot": ("footer", "copyright", "legal", "colophon", "contentinfo"),
    "side": ("sidebar", "aside", "side", "rail", "complementary", "widget", "related", "recommended", "trending", "popular", "teaser", "more", "tags", "author", "bio"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "outbrain", "taboola", "adsbygoogle"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "alertdialog", "popup", "modal", "overlay", "toast", "paywall", "warning"),
    "form": ("form", "search", "login", "signup", "newsletter", "subscribe", "subscription", "register", "contact"),
    "comment": ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "reviews", "feedback"),
    "share": ("share", "sharing", "social", "follow", "like", "print", "toolbar", "meta", "byline"),
    "hidden": ("hidden", "invisible", "screenreader", "visuallyhidden", "offscreen"),
}
HINT_NAMES = tuple(HINTS)
_HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words}
_PREFIXES = tuple((w, i) for w, i in _HINT_OF.items() if len(w) >= 4)

#: Tags that are part of the text around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
#: Tags whose content is characters up to their end tag, and tags whose whole content is not text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head noscript template svg math object audio video canvas select datalist button map applet".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: What a start tag closes, up to the tags that bound it.
CLOSES = {t: ({"li"}, {"ul", "ol", "menu"}) for t in ("li",)} | {t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")} | {t: ({"td", "th"}, {"table", "tr"}) for t in ("td", "th")}
CLOSES |= {"tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|([^>]*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden|data-content)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])""", re.I)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?。、！？]")


@dataclass
class Tree:
    """Nodes in page order; a parent stands before its children. Elements without text are left out."""

    parent: list[int]
    kind: list[int]
    hints: list[int]
    #: Of leaves: the text; None for elements.
    text: list[str | None]
    #: Characters, of them in links, and punctuation; of elements, of all below.
    chars: list[int]
    linked: list[int]
    points: list[int]
    #: 1 or 0 where the markup or the layout says so.
    label: list[int]


def hints_of(attributes: str) -> tuple[int, int | None]:
    """Bits of the groups of words in a tag's attributes; the label that a layout wrote."""
    bits, label = 0, None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-content":
            label = int(value == "1")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bits |= 1 << HINT_NAMES.index("hidden")
        elif name in ("class", "id", "role"):
            for word in _HINT_WORD.findall(value):
                word = word.lower()
                if word in _HINT_OF:
                    bits |= 1 << _HINT_OF[word]
                elif len(word) > 4:
                    bits |= next((1 << i for w, i in _PREFIXES if word.startswith(w)), 0)
    return bits, label


_NOT_CONTENT = frozenset(KINDS.index(k) for k in ("nav", "footer", "aside", "form", "dialog"))
_CONTENT_BIT = 1 << HINT_NAMES.index("content")


def parse(page: str | None) -> Tree:
    """The tree of a page's blocks."""
    page = page or ""
    parent, kind, hints, text, linked, label = [-1], [KINDS.index("body")], [0], [None], [0], [0]
    tags, open_nodes, in_article = ["body"], [0], [False]
    told: list[int | None] = [None]
    buffer: list[str] = []
    links = link_depth = 0
    unseen, unseen_depth = "", 0

    def flush() -> None:
        nonlocal links
        if buffer:
            words = " ".join(unescape("".join(buffer)).split())
            if words:
                parent.append(open_nodes[-1])
                kind.append(0)
                hints.append(0)
                text.append(words)
                linked.append(min(links, len(words)))
                label.append(int(in_article[-1]) if told[-1] is None else told[-1])
            buffer.clear()
        links = 0

    def close(to: int) -> None:
        flush()
        del tags[to:], open_nodes[to:], in_article[to:], told[to:]

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        lt = size if lt < 0 else lt
        if lt > at and not unseen:
            buffer.append(page[at:lt])
            links += (lt - at) * bool(link_depth)
        if lt == size:
            break
        token = _TOKEN.match(page, lt)
        if token is None:  # a lone sign
            if not unseen:
                buffer.append("<")
            at = lt + 1
            continue
        at = token.end()
        if not token[2]:
            continue
        tag, ends = token[2].lower(), bool(token[1])
        if tag in RAW and not ends:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if unseen:
            # A head ends where the body begins, whatever is open.
            if unseen == "head" and (tag == "body" or (not ends and tag not in ("meta", "link", "base", "noscript", "head", "template"))):
                unseen = ""
            else:
                unseen_depth += (tag == unseen) * (-1 if ends else 1)
                unseen = unseen if unseen_depth else ""
                continue
        if tag in UNSEEN:
            if not ends and not page.startswith("/>", at - 2):
                unseen, unseen_depth = tag, 1
            continue
        if tag == "br":
            buffer.append(" ")
        elif tag in INLINE:
            if tag == "a":
                link_depth = 0 if ends else 1
        elif tag in ("html", "body"):
            if not ends:
                flush()
                hints[0] |= hints_of(token[3] or token[4] or "")[0]
        elif tag in VOID:
            flush()
        elif ends:
            bounds = ({"ul", "ol", "menu"} if tag == "li" else {"table"} if tag in ("td", "th", "tr") else ()) if tag != "table" else ()
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] == tag or (tag[0] == "h" and tag in KIND_OF and KIND_OF[tag] == "heading" and KIND_OF.get(tags[i]) == "heading"):
                    close(i)
                    break
                if tags[i] in bounds:
                    break
            else:
                flush()
        else:
            if tags[-1] == "p" or KIND_OF.get(tags[-1]) == "heading":  # no block stands in a paragraph
                close(len(tags) - 1)
            shut, bounds = CLOSES.get(tag, ((), ()))
            for i in range(len(tags) - 1, 0, -1) if shut else ():
                if tags[i] in shut:
                    close(i)
                    break
                if tags[i] in bounds:
                    break
            flush()
            bits, said = hints_of(token[3] or token[4] or "") if token[3] or token[4] else (0, None)
            k = KINDS.index(KIND_OF.get(tag, "div"))
            parent.append(open_nodes[-1])
            kind.append(k)
            hints.append(bits)
            text.append(None)
            linked.append(0)
            label.append(0)
            if not page.startswith("/>", at - 2) or tag in KIND_OF:
                tags.append(tag)
                open_nodes.append(len(parent) - 1)
                in_article.append((in_article[-1] or tag == "article") and k not in _NOT_CONTENT and not bits & ~_CONTENT_BIT)
                told.append(told[-1] if said is None else said)
            link_depth = 0
    flush()
    return _with_text(Tree(parent, kind, hints, text, [len(t or "") for t in text], linked, [len(_PUNCTUATION.findall(t)) if t else 0 for t in text], label))


def _with_text(t: Tree) -> Tree:
    """Without elements that hold no text, with sums; an element's label is that of most of its text."""
    content = [c * y for c, y in zip(t.chars, t.label, strict=True)]
    for i in range(len(t.parent) - 1, 0, -1):
        up = t.parent[i]
        t.chars[up] += t.chars[i]
        t.linked[up] += t.linked[i]
        t.points[up] += t.points[i]
        content[up] += content[i]
    keep = [i for i in range(len(t.parent)) if t.chars[i] or not i]
    new = {old: n for n, old in enumerate(keep)}
    pick = lambda column: [column[i] for i in keep]
    label = [int(2 * content[i] > t.chars[i]) for i in keep]
    return Tree([new.get(t.parent[i], -1) for i in keep], pick(t.kind), pick(t.hints), pick(t.text), pick(t.chars), pick(t.linked), pick(t.points), label)


@dataclass
class Forest:
    """Trees side by side, in arrays: parents (-1 for roots), nodes by depth, one feature of each sort for each node, hints as 0 and 1, classes of edges."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    hints: np.ndarray
    edge: np.ndarray
    label: np.ndarray


#: Zones: the nearest of these around a node, or an element with words of another group than content.
ZONES = tuple(KINDS.index(k) for k in ("article", "main", "header", "nav", "footer", "aside", "form", "dialog"))
_OPEN_ZONES, _HEADER_ZONE = 2, 3
#: Kind; a leaf's parent's kind; and for elements and leaves each: length, share in links, punctuation, place in the page, zone.
_SORTS = (len(KINDS), len(KINDS) + 1, 2 * 10, 2 * 5, 2 * 5, 2 * 4, 2 * (len(ZONES) + 2))
_STARTS = np.cumsum([0, *_SORTS])
N_FEATURES, N_EDGES = int(_STARTS[-1]), 2 * len(KINDS)


def forest(trees: list[Tree]) -> Forest:
    column = lambda name: np.array([x for t in trees for x in getattr(t, name)], np.int64)
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = column("parent")
    parent = np.where(parent < 0, -1, parent + first)
    kind, bits, chars, linked, points = (column(c) for c in ("kind", "hints", "chars", "linked", "points"))
    depth, zone = [0] * len(parent), [0] * len(parent)
    zone_of = {k: i + 1 for i, k in enumerate(ZONES)}
    for i, (p, k, b) in enumerate(zip(parent.tolist(), kind.tolist(), bits.tolist(), strict=True)):
        depth[i] = depth[p] + 1 if p >= 0 else 0
        own, around = len(ZONES) + 1 if b & ~_CONTENT_BIT else zone_of.get(k, 0), zone[p] if p >= 0 else 0
        # What stands in a menu or among comments stays there, articles too; a header in an article is the article's.
        zone[i] = around if around > _OPEN_ZONES or not own or (around and own == _HEADER_ZONE) else own
    depth, zone = np.array(depth, np.int64), np.array(zone, np.int64)
    leaf = kind == 0
    some = np.maximum(chars, 1)
    length = np.minimum(np.log2(some).astype(np.int64), 9)
    share = np.searchsorted([0.01, 0.25, 0.6, 0.95], linked / some, "right")
    density = np.searchsorted([0.0001, 0.008, 0.02, 0.05], points / some, "right")
    place = np.searchsorted([0.05, 0.5, 0.95], (np.arange(len(parent)) - first) / np.maximum(np.repeat(sizes, sizes), 1), "right")
    above = np.where(leaf & (parent >= 0), kind[np.maximum(parent, 0)], len(KINDS))
    sorts = (kind, above, length + 10 * leaf, share + 5 * leaf, density + 5 * leaf, place + 4 * leaf, zone + (len(ZONES) + 2) * leaf)
    features = np.stack([s + start for s, start in zip(sorts, _STARTS[:-1], strict=True)], 1)
    hints = ((bits[:, None] >> np.arange(len(HINTS))) & 1).astype(float)
    edge = kind + len(KINDS) * ((bits & ~_CONTENT_BIT) > 0)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
    return Forest(parent, levels, features, hints, edge, column("label"))


@dataclass
class Model:
    unary: np.ndarray  # of features
    hints: np.ndarray
    edges: np.ndarray  # [class of edge, parent's label, child's label]


def sum_product(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Content marginals of all nodes, and marginals [node, parent's label, own label] of their edges to their parents."""
    own = np.zeros((len(f.parent), 2))
    own[:, 1] = m.unary[f.features].sum(1) + f.hints @ m.hints
    psi = m.edges[f.edge]
    sent = np.zeros_like(own)
    for nodes in f.levels[:0:-1]:  # upward
        message = psi[nodes] + own[nodes][:, None, :]
        sent[nodes] = np.logaddexp(message[:, :, 0], message[:, :, 1])
        np.add.at(own, f.parent[nodes], sent[nodes])
    down, pairs = np.zeros_like(own), np.zeros((len(f.parent), 2, 2))
    for nodes in f.levels[1:]:  # downward
        up = f.parent[nodes]
        rest = own[up] + down[up] - sent[nodes]
        joint = rest[:, :, None] + psi[nodes]
        down[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = joint + own[nodes][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        np.exp(joint, out=joint)
        pairs[nodes] = joint / joint.sum((1, 2), keepdims=True)
    belief = own + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pairs


def fit(trees: list[Tree], steps: int = STEPS) -> Model:
    """Gradient ascent (Adam) of the conditional log likelihood of whole labelled trees."""
    f = forest(trees)
    sizes = (N_FEATURES, len(HINTS), N_EDGES * 4)
    theta, mean, square = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))

    def model() -> Model:
        unary, hints, edges = np.split(theta, np.cumsum(sizes)[:-1])
        return Model(unary, hints, edges.reshape(N_EDGES, 2, 2))

    y, n, child = f.label, max(len(f.label), 1), np.flatnonzero(f.parent >= 0)
    for step in range(1, steps + 1):
        p, pairs = sum_product(f, model())
        off = y - p
        edges = np.zeros((N_EDGES, 2, 2))
        np.add.at(edges, (f.edge[child], y[f.parent[child]], y[child]), 1)
        np.add.at(edges, f.edge[child], -pairs[child])
        unary = np.bincount(f.features.ravel(), weights=np.repeat(off, f.features.shape[1]), minlength=N_FEATURES)
        grad = np.concatenate([unary, off @ f.hints, edges.ravel()]) / n - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model()


# Labelled layouts ---------------------------------------------------------------------------------------------------

_SKINS = {
    "menu": (("nav", ""), ("div", "site-nav"), ("ul", "main-menu"), ("div", "breadcrumbs"), ("div", "navigation")),
    "head": (("header", ""), ("div", "page-header"), ("div", "masthead"), ("div", "topbar")),
    "foot": (("footer", ""), ("div", "footer"), ("div", "site-footer copyright"), ("section", "legal")),
    "side": (("aside", ""), ("div", "sidebar"), ("section", "related-posts"), ("div", "widget"), ("aside", "trending")),
    "ad": (("div", "ad"), ("div", "advert"), ("aside", "sponsored"), ("div", "promo-banner"), ("section", "ads")),
    "notice": (("div", "cookie-notice"), ("dialog", ""), ("section", "consent"), ("div", "alert popup"), ("div", "paywall")),
    "form": (("form", ""), ("div", "newsletter"), ("div", "search-form"), ("form", "login"), ("form", "subscribe")),
    "comment": (("section", "comments"), ("div", "comment-list"), ("div", "disqus"), ("ol", "comments"), ("div", "replies")),
    "share": (("div", "social-share"), ("div", "share"), ("ul", "follow"), ("div", "post-meta")),
}


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def layout(r: random.Random, content: list[str], other: list[str]) -> str:
    """A page of the given texts in a drawn layout; data-content says what is content."""

    def some() -> str:
        return r.choice(other) if other and r.random() < 0.7 else r.choice(content) if content else "text"

    def element(tag: str, cls: str, inner: str, y: str = "") -> str:
        name = f' {r.choice(("class", "id", "class"))}="{cls}"' if cls else ""
        return f"<{tag}{name}{y}>{inner}</{tag}>"

    def clutter(group: str) -> str:
        tag, cls = r.choice(_SKINS[group])
        if group in ("menu", "share") or (group in ("side", "foot", "head") and r.random() < 0.5):
            items = "".join(f'<li><a href="#">{_escaped(" ".join(some().split()[: r.randint(1, 6)]))}</a></li>' for _ in range(r.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif group == "comment":
            wrap = "li" if tag == "ol" else r.choice(("div", "p", "article", "div"))
            inner = "".join(element(wrap, r.choice(("comment", "reply", "")), r.choice(("<p>{}</p>", "{}")).format(_escaped(some()))) for _ in range(r.randint(1, 6)))
            inner = (f"<h{r.randint(2, 4)}>{r.randint(2, 99)} comments</h3>" if tag != "ol" and r.random() < 0.6 else "") + inner
        elif group == "form":
            inner = f"<label>{_escaped(some()[:40])}</label><input><p>{_escaped(some()[:90])}</p>"
        else:
            inner = r.choice(("{}", "<p>{}</p>", "<h3>More</h3><p>{}</p>", "<div><p>{}</p></div>")).format(_escaped(some()[: r.choice((30, 80, 400))]))
        return element(tag, cls, inner, ' data-content="0"')

    blocks, i = [], 0
    while i < len(content):
        t = _escaped(content[i])
        if not i:
            h = f"<h1>{t}</h1>"
            blocks.append(h if r.random() < 0.7 else f"<header>{h}</header>")
        else:
            form = r.choices(("p", "h2", "li", "blockquote", "pre", "cell", "figure", "bare", "div"), (60, 6, 8, 4, 3, 3, 3, 6, 7))[0]
            linked = f'<a href="/x">{t}</a>' if r.random() < 0.03 else t
            blocks.append({
                "p": f"<p>{linked}</p>", "h2": f"<h{r.randint(2, 4)}>{t}</h2>", "li": f"<ul><li>{linked}</li><li>{_escaped(content[i - 1])}</li></ul>", "blockquote": f"<blockquote>{t}</blockquote>", "pre": f"<pre>{t}</pre>",
                "cell": f"<table><tr><td>{t}</td><td>{r.randint(1, 99)}</td></tr></table>", "figure": f"<figure><img src=x><figcaption>{t}</figcaption></figure>", "bare": f"{t}<br><br>", "div": f"<div>{linked}</div>",
            }[form])
        i += 1
    for group in r.choices(("ad", "side", "notice", "share", "form", "comment"), k=r.choice((0, 0, 1, 2, 3))):
        at = len(blocks) if group == "comment" else r.randint(1, max(1, len(blocks)))
        blocks.insert(at, clutter(group))
    tag, cls = r.choices((("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("section", "story"), ("div", "post"), ("div", "")), (35, 12, 14, 12, 8, 8, 8))[0]
    body = element(tag, cls, "".join(blocks), ' data-content="1"')
    if r.random() < 0.4:
        body = element(r.choice(("div", "main", "section")), r.choice(("", "wrapper", "container", "content")), body + (clutter("side") if r.random() < 0.4 else ""))
    before = [clutter(g) for g in r.choices(("menu", "head", "ad", "notice", "form", "side", "menu", "head"), k=r.randint(0, 4))]
    after = [clutter(g) for g in r.choices(("foot", "side", "comment", "ad", "share", "foot", "notice"), k=r.randint(0, 4))]
    return f"<html><head><title>{_escaped(some())}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def _filler(r: random.Random) -> tuple[list[str], list[str]]:
    word = lambda: "".join(r.choice(("ta", "ri", "no", "le", "su", "men", "der")) for _ in range(r.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    return [" ".join(sentence(r.randint(1, 18)) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 14))], [sentence(r.randint(1, 14)) for _ in range(12)]


_ARRAYS = ("parent", "kind", "hints", "chars", "linked", "points", "label")


def _numbers(seed: int, trees: list[Tree]) -> Iterator[tuple]:
    for t in trees:
        yield (seed, *(getattr(t, c) for c in _ARRAYS))


def labelled_trees(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[Tree]:
    """Trees with labels, without texts, of a sample of at most about `most` pages (those with the least hashes of their ids, so the same
    on each run) and of other layouts of their texts, and of layouts of filler."""
    n = pages.count()
    share = min(1.0, most / max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for seed, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = page.as_py()
                if len(re.findall(r"<article\b", page or "", re.I)) != 1:
                    continue
                t = parse(page)
                if not 1 < len(t.parent) <= SAMPLE_BLOCKS:
                    continue
                content = [x for x, y in zip(t.text, t.label, strict=True) if x and y]
                other = [x for x, y in zip(t.text, t.label, strict=True) if x and not y]
                r = random.Random(seed)
                rows += _numbers(seed, [t, *(parse(layout(r, content, other)) for _ in range(LAYOUTS))] if content else [])
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:])], names=["seed", *_ARRAYS])

    seed = F.crc32(F.concat_ws(" ", F.lit("page"), F.col("page_id").cast("string")))
    chosen = pages.select(seed.alias("seed"), F.col("html").cast("string").alias("html")).filter(F.col("seed") < int(share * 2**32))
    found = chosen.mapInArrow(run, "seed long, " + ", ".join(f"{c} array<long>" for c in _ARRAYS)).collect()
    rows = sorted((tuple(r) for r in found))
    r = random.Random(1)
    filler = [parse(layout(r, *_filler(r))) for _ in range(FILLER_PAGES)]
    return [Tree(p, k, h, [None] * len(p), c, li, po, y) for _, p, k, h, c, li, po, y in rows] + filler


def train(pages: DataFrame) -> Model:
    return fit(labelled_trees(pages))


# Extraction ---------------------------------------------------------------------------------------------------------


def score_trees(trees: list[Tree], model: Model) -> Iterator[list[tuple[str, float]]]:
    """(text, content marginal) of each tree's blocks, in page order."""
    p, _ = sum_product(forest(trees), model)
    at = 0
    for t in trees:
        yield [(x, float(q)) for x, q in zip(t.text, p[at : at + len(t.text)], strict=True) if x is not None]
        at += len(t.text)


def _scored(pages: Iterator[str | None], model: Model) -> Iterator[list[tuple[str, float]]]:
    """Blocks of each page, scored many pages at a time."""
    trees, nodes = [], 0
    for page in pages:
        trees.append(t := parse(page))
        nodes += len(t.parent)
        if nodes >= NODES_AT_ONCE:
            yield from score_trees(trees, model)
            trees, nodes = [], 0
    yield from score_trees(trees, model)


def blocks(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, and blocks: text and content marginal of each block of the page, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("text", pa.string()), ("content", pa.float64())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [[{"text": t, "content": q} for t, q in b] for b in _scored((x.as_py() for x in part.column(2)), model)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, block)], names=["page_id", "url", "blocks"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, blocks array<struct<text: string, content: double>>")


def extract(pages: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of each page; the model is trained on pages if none is given."""
    found = blocks(pages, model or train(pages))
    kept = F.transform(F.filter("blocks", lambda b: b["content"] >= least), lambda b: b["text"])
    text = F.array_join(kept, " ")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
