"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of its block elements. Every node has a hidden label: structure (it holds both),
content, or boilerplate. Unary potentials say how well a node's tag, the hint in its class, id or role,
its share of link text and its amount of text suit a label; parent-child potentials say how labels
follow each other. Sum-product messages go up from the leaves and down again, which gives the exact
marginal of every node; the text of a block is kept where content has the largest.

The potentials are trained here, by counting over labelled pages: any pages whose elements carry a
``data-label`` (S, C or B; without one, the parent's). ``labelled_pages`` makes ``TRAINING_PAGES`` such
pages in many layouts from a fixed seed; a caller may give its own instead.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed
and joined by line feeds in page order. Scripts, styles, templates, titles, form controls, embedded
media and comments are no text. Elements that HTML lets unclosed end where it says, the head among
them; stray end tags are ignored. An unclosed script, style, template or textarea runs to the page's
end, as HTML says; any other element without its end tag hides nothing.

Nulls: a null or empty html has an empty text; a null page_id or url is kept. Very long pages are read
whole, in one pass. Where labels tie, a block counts as content. Repeated rows are extracted alike. An
empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, only, slices

LABELS = "SCB"  # structure, content, boilerplate
#: Pages that the model is trained on, and what is added to every count.
TRAINING_PAGES, SMOOTHING = 800, 1.0
#: Stands for every tag; what a feature never seen says.
ANY, UNSEEN = "*", (0.0, 0.0, 0.0)

# Element names of HTML.
RAW = frozenset("script style noscript template title svg iframe object select textarea button canvas audio video".split())
TO_END = frozenset("script style template textarea".split())
MATHS = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded menclose msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split())
INLINE = MATHS | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr picture source input meta link base col embed param track area".split())
VOID = frozenset("hr input img br meta link base col embed param source track wbr area".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an element ends when it begins, and what keeps it from looking further out.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# Words in class, id or role that hint at a label.
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar side aside footer foot header head masthead topbar ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert"
    " comment comments commentlist disqus reply replies respond social share sharing follow related recommended recommendations breadcrumb breadcrumbs widget popup modal overlay subscribe subscription newsletter signup login search form"
    " copyright legal pagination pager tags toolbar contentinfo complementary hidden skip toc outbrain taboola".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text maincontent".split())
#: In a class such as has-comments or sidebar-layout: it says what the page has, not what the element is.
LAYOUT_WORDS = frozenset("has with without no layout template theme enabled".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("chars", "children", "hint", "label", "link_chars", "parent", "tag")

    def __init__(self, tag: str, parent: int, hint: str, label: str | None):
        self.tag, self.parent, self.hint, self.label = tag, parent, hint, label
        self.chars = self.link_chars = 0
        self.children: list[int] = []


def hint_of(attributes: str) -> tuple[str, str | None]:
    """The hint in an element's attributes, and its training label."""
    if not attributes.strip(" /"):
        return "none", None
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    named = [set(_WORD.findall(x)) for x in " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split()]
    words = set().union(*(x for x in named if not x & LAYOUT_WORDS))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    hint = "boilerplate" if hidden or words & BOILERPLATE_WORDS else "content" if words & CONTENT_WORDS else "none"
    return hint, found.get("data-label")


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The tree of block elements, parents before children, and the blocks of text: (node, text) in page order."""
    nodes, blocks, stack, run, links, at = [Node("root", -1, "none", "S")], [], [0], [], 0, 0

    def end_block() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                owner = stack[-1]
                if nodes[owner].tag in ("root", "html", "body"):  # text of the page itself is a paragraph
                    nodes.append(Node("p", owner, "none", nodes[owner].label))
                    nodes[owner].children.append(owner := len(nodes) - 1)
                blocks.append((owner, text))
                nodes[owner].chars += len(text)

    def add(text: str) -> None:
        run.append(text)
        if links:
            nodes[stack[-1]].link_chars += len(text.strip())

    unclosed: set[str] = set()  # raw elements that have no end tag from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if closing or tag == "svg" and attributes.endswith("/"):
                continue
            ends = None if tag in unclosed else _ENDS[tag].search(page, at)
            if ends:
                at = ends.end()
            else:
                unclosed.add(tag)
                at = len(page) if tag in TO_END else at
            if ends and tag not in ("svg", "button"):
                end_block()
            continue
        if tag == "head":
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            continue
        end_block()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    del stack[depth:]
                    links = 0
                    break
            continue
        if tag in ENDS_PARAGRAPH and nodes[stack[-1]].tag == "p":
            stack.pop()
            links = 0
        if tag in ENDS:
            ended, walls = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                inner = nodes[stack[depth]].tag
                if inner in ended:
                    del stack[depth:]
                    if tag != "tr":
                        break
                elif inner in walls:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in ENDS_PARAGRAPH:
            continue
        hint, label = hint_of(attributes)
        nodes.append(Node(tag, stack[-1], hint, label or nodes[stack[-1]].label))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    if at < len(page):
        add(page[at:])
    end_block()
    return nodes, blocks


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """The observed features of each node, each with its tag: share of link text, hint, amount of text (of the whole subtree)."""
    chars, link = [n.chars for n in nodes], [n.link_chars for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        link[nodes[i].parent] += link[i]
    out = []
    for n, c, k in zip(nodes, chars, link, strict=True):
        share = k / c if c else 0
        density = "none" if not c else "0" if not k else "low" if share < 0.3 else "half" if share < 0.7 else "high"
        size = "0" if not c else "25" if c < 25 else "100" if c < 100 else "400" if c < 400 else "more"
        own = "own" if n.chars else "no"
        out.append((f"links:{n.tag} {density}", f"hint:{n.tag} {n.hint}", f"size:{n.tag} {size}{own}"))
    return out


class Model:
    """Potentials of labels given features, and of a child's label given its tag and its parent's label."""

    def __init__(self, unary: dict[str, tuple[float, ...]], pairs: dict[str, list[list[float]]]):
        self.unary, self.pairs = unary, pairs

    @classmethod
    def fit(cls, pages: list[str]) -> Model:
        seen, of, follows = Counter(), Counter(), Counter()
        ways: dict[str, set[str]] = {}
        for page in pages:
            nodes, _ = parse(page)
            for n, found in zip(nodes[1:], features(nodes)[1:], strict=True):
                for tag in (n.tag, ANY):
                    follows[tag, nodes[n.parent].label, n.label] += 1
                for f in (*found, f"hint:{ANY} {n.hint}"):
                    seen[f, n.label] += 1
                    of[f.partition(" ")[0], n.label] += 1
                    ways.setdefault(f.partition(" ")[0], set()).add(f)
        unary = {f: tuple(log((seen[f, y] + SMOOTHING) / (of[kind, y] + SMOOTHING * len(fs))) for y in LABELS) for kind, fs in ways.items() for f in fs}

        def table(tag: str, prior: list[list[float]]) -> list[list[float]]:
            """Counted transitions of a tag; where few were seen, those of all tags to the labels that this tag has."""
            has = [sum(follows[tag, a, b] for a in LABELS) + 0.05 for b in LABELS]
            prior = [[p * h for p, h in zip(row, has, strict=True)] for row in prior]
            prior = [[p / sum(row) for p in row] for row in prior]
            sums = [sum(follows[tag, a, y] for y in LABELS) for a in LABELS]
            return [[(follows[tag, a, b] + p) / (n + 1) for b, p in zip(LABELS, row, strict=True)] for a, n, row in zip(LABELS, sums, prior, strict=True)]

        every = table(ANY, [[1 / 3] * 3] * 3)
        return cls(unary, {t: table(t, every) for t, _, _ in follows} | {ANY: every})

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Sum-product over the tree: the probability of each label of each node."""
        many, pair = len(nodes), [self.pairs.get(x.tag) or self.pairs[ANY] for x in nodes]
        local = []
        for n, found in zip(nodes, features(nodes), strict=True):
            potential = [0.0, 0.0, 0.0]
            for f in found:
                u = self.unary.get(f) or self.unary.get(f"hint:{ANY} {n.hint}" if f.startswith("hint:") else "", UNSEEN)
                potential = [p + x for p, x in zip(potential, u, strict=True)]
            top = max(potential)
            local.append([exp(p - top) for p in potential])
        for i, x in enumerate(nodes):
            if x.tag in ("root", "html", "body"):  # structure by definition
                local[i] = [1.0, 0.0, 0.0]
        up = [[1.0, 1.0, 1.0] for _ in range(many)]  # from a node to its parent
        inside = [list(x) for x in local]
        for i in range(many - 1, 0, -1):
            message = [sum(p * x for p, x in zip(row, inside[i], strict=True)) for row in pair[i]]
            total = sum(message)
            up[i] = [m / total for m in message]
            parent = inside[nodes[i].parent]
            scaled = [a * b for a, b in zip(parent, up[i], strict=True)]
            total = sum(scaled)
            inside[nodes[i].parent] = [x / total for x in scaled]
        belief = [[] for _ in range(many)]
        belief[0] = inside[0]
        for i in range(1, many):
            without = [b / u if u else 0.0 for b, u in zip(belief[nodes[i].parent], up[i], strict=True)]
            down = [sum(without[a] * pair[i][a][b] for a in range(3)) for b in range(3)]
            both = [d * x for d, x in zip(down, inside[i], strict=True)]
            total = sum(both)
            belief[i] = [x / total for x in both]
        return belief

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        belief = self.marginals(nodes)
        return "\n".join(text for i, text in blocks if belief[i][1] == max(belief[i]))


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    """Pages in many layouts, every element's label known."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ka lo mi ter un da sel or vin qua pre est".split()) for _ in range(rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    pick = rng.choice

    def el(tag: str, inner: str, label: str = "", attr: str = "") -> str:
        return f"<{tag} {attr}{f' data-label={label}' if label else ''}>{inner}</{tag}>"

    def linked(text: str) -> str:
        return f"{text} {link()} {words(1, 4)}" if rng.random() < 0.35 else text

    def heading() -> str:
        return pick([el(pick(["h2", "h3", "h4"]), words(1, 3)), ""])

    def paragraph() -> str:
        size = pick([(1, 3), (4, 12), (15, 60), (40, 150)])
        text = words(*size)
        if rng.random() < 0.2:
            text += " " + link() + " " + words(1, 8)
        if rng.random() < 0.15:
            text = f"<b>{words(1, 6)}</b> " + text
        return el("p", text)

    def story() -> str:
        parts = [el(pick(["h1", "h2"]), words(2, 12))] if rng.random() < 0.85 else []
        if rng.random() < 0.12:
            parts = [el("header", "".join(parts) + el("p", words(1, 6)), "B")]
        for _ in range(pick([1, 1, 2, rng.randint(1, 14), rng.randint(1, 14)])):
            kind = rng.random()
            if kind < 0.7:
                parts.append(paragraph())
            elif kind < 0.76:
                parts.append(el(pick(["h2", "h3", "h4"]), words(1, 8)))
            elif kind < 0.81:
                parts.append(el(pick(["ul", "ol"]), "".join(el("li", words(1, 25)) for _ in range(rng.randint(1, 6)))))
            elif kind < 0.85:
                parts.append(el("blockquote", pick([paragraph(), words(5, 40)])))
            elif kind < 0.88:
                parts.append(el("table", "".join(el("tr", "".join(el(pick(["td", "th"]), words(1, 4)) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
            elif kind < 0.91:
                parts.append(el("pre", words(3, 30)))
            elif kind < 0.94:
                parts.append(el(pick(["section", "div"]), "".join(paragraph() for _ in range(rng.randint(1, 4)))))
            elif kind < 0.96:
                parts.append(el("figure", el("figcaption", words(3, 15))))
            else:
                parts.append(intruder())
        if rng.random() < 0.12:
            parts.append(el("footer", pick([words(1, 12), el("p", words(1, 12))]), "B"))
        if rng.random() < 0.15:
            parts.append(comments())
        return "".join(parts)

    def intruder() -> str:
        return pick([
            lambda: el(pick(["div", "aside", "section"]), pick([words(2, 20), el("p", words(3, 25))]), "B", f'class="{pick(["ad", "ads", "advert", "promo", "sponsored", "ad-slot"])}"'),
            lambda: el("aside", heading() + el("ul", "".join(el("li", link(2, 7)) for _ in range(4))), "B", pick(['class="related"', ""])),
            lambda: el("div", " ".join(link() for _ in range(3)), "B", f'class="{pick(["share", "social", "tags"])}"'),
            lambda: el("form", el("p", words(3, 12)) + f'<label>{words(1, 2)}</label><input name="q">', "B", pick(['class="newsletter"', ""])),
            lambda: el("div", el("p", linked(words(5, 25))), "B", f'class="{pick(["notice", "alert", "cookie-notice", "banner"])}"'),
        ])()

    def comments() -> str:
        said = lambda: pick([el("p", words(1, 3)), ""]) + "".join(el("p", linked(words(*pick([(1, 4), (3, 20), (5, 50)])))) for _ in range(rng.randint(1, 2))) if rng.random() < 0.75 else linked(words(1, 25))
        one = lambda: pick([lambda: el("article", said(), "", 'class="comment"'), lambda: el(pick(["div", "li"]), said(), "", pick(['class="comment"', ""]))])()
        inner = heading() + "".join(one() for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            inner = heading() + el(pick(["ol", "ul"]), "".join(el("li", said()) for _ in range(rng.randint(1, 5))))
        return el(pick(["section", "div", "ol"]), inner, "B", pick(['class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus_thread"']))

    def before() -> list[str]:
        menu = lambda: el("ul", "".join(el("li", link()) for _ in range(rng.randint(3, 9))))
        made = [el("nav", pick([menu(), " ".join(link() for _ in range(5))]), "B")] if rng.random() < 0.7 else [el("div", menu(), "B", f'class="{pick(["menu", "navbar", "nav"])}"')]
        if rng.random() < 0.5:
            made.append(el("header", pick([el("h1", words(1, 4)), ""]) + el("p", linked(words(2, 12))) + pick([menu(), ""]), "B"))
        if rng.random() < 0.3:
            made.append(el("div", el("p", words(2, 10)), "B", pick(['class="header"', 'id="header"', 'role="banner"'])))
        made += [intruder() for _ in range(rng.randint(0, 2))]
        return made

    def side() -> str:
        inner = heading() + pick([el("ul", "".join(el("li", link(2, 8)) for _ in range(5))), el("p", linked(words(5, 50))), el("div", linked(words(3, 30)))])
        return pick([lambda: el("aside", inner, "B"), lambda: el("div", inner, "B", f'class="{pick(["sidebar", "widget", "side"])}"')])()

    def after() -> list[str]:
        made = [comments()] if rng.random() < 0.35 else []
        made += [side()] if rng.random() < 0.3 else []
        foot = pick([words(3, 20), el("p", linked(words(3, 25))), el("p", "&copy; " + words(1, 5)) + el("ul", "".join(el("li", link()) for _ in range(4)))])
        made.append(pick([lambda: el("footer", foot, "B"), lambda: el("footer", foot, "B"), lambda: el("div", foot, "B", pick(['class="footer"', 'id="footer"', 'role="contentinfo"']))])())
        return made

    def page() -> str:
        inner = story()
        main = pick([
            lambda: el("article", inner, "C"), lambda: el("article", inner, "C", 'class="post"'), lambda: el("main", inner, "C"), lambda: el("main", el("article", inner, "C"), "S"),
            lambda: el("div", inner, "C", f'class="{pick(["content", "post", "entry-content", "article-body", "story"])}"'), lambda: el("div", inner, "C", pick(['id="main"', 'id="content"', ""])),
            lambda: el("main", side() + el("article", inner, "C"), "S"), lambda: el("section", inner, "C"), lambda: el("div", el("div", inner, "C"), "S", pick(['class="container"', 'class="row"', ""])),
            lambda: el("div", inner, "C"), lambda: el("div", el("div", inner, "C"), "S"), lambda: el("div", el("article", inner, "C"), "S"),
        ])()
        if rng.random() < 0.08:
            main = el("article", el("h1", words(1, 12)) + pick([paragraph(), ""]), "C")
        body = main if rng.random() < 0.15 else "".join([*before(), *([side()] if rng.random() < 0.2 else []), main, *after()])
        if rng.random() < 0.05:  # nothing around the text
            body = "".join(el("p", words(*pick([(2, 10), (10, 60)])), "C") for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.4:
            body = el("div", body, "S", pick(['id="wrapper"', 'class="page"', ""]))
        return f"<!DOCTYPE html><html data-label=S><head><title>{words(2, 6)}</title></head><body data-label=S>{body}</body></html>"

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model of the bundled pages; the same wherever it is trained."""
    return Model.fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row. No shuffle."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [model.extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(only(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
