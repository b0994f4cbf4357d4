"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the text between the borders of block elements.
Each block has features of its ancestors (tags, words of class and id), of its
text (length, links, sentences), of its neighbours, and of the page: whether it
stands inside the deepest element that holds most of the page's sentences, and
whether it is one of a row of short pieces. The latter ask for no language and
no names. A linear-chain CRF, trained on labelled pages, gives each block the
label main or other by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import lean

# ------------------------------------------------------------------ blocks

#: Elements (HTML standard) of which the text is not part of a page's flow.
SILENT = {"script", "style", "head", "title", "template", "noscript", "iframe", "svg", "math", "object", "select", "textarea", "button", "option", "canvas", "audio", "video", "map"}
#: Elements whose content is raw text up to their own end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that flow inside a block; all others border one.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Start tags that close an open element of the same or a kindred kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "aside", "nav", "header", "footer", "form", "blockquote"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}


class Node:
    """A block element with its parent; `around` are the features of all elements from the root to it, kept once they are asked for."""

    __slots__ = ("tag", "words", "parent", "number", "depth", "around")

    def __init__(self, tag: str, words: str, parent: Node | None, number: int):
        self.tag, self.words, self.parent, self.number = tag, words, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.around: frozenset[int] | None = None


def leaf_blocks(page: str) -> list[tuple[Node | None, str, int]]:
    """Blocks in page order: (innermost block element, text, characters inside links). Elements are shared by the blocks in them, so deep pages take no more room than flat ones."""
    out: list = []
    stack: list[tuple[str, Node | None]] = []  # inline elements with the block element they stand in
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = silent = links = nodes = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((stack[-1][1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal silent, links
        for tag, _ in stack[upto:]:
            silent -= tag in SILENT
            links -= tag == "a"
            opened[tag] -= 1
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        m = _TOKEN.match(page, begin) if begin >= 0 else None
        if begin < 0:
            begin = end = n
        else:
            end = m.end() if m else begin + 1
        text = page[at:begin] if m or begin == n else page[at:end]
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text.strip())
        at = end
        if not m:
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag does not close blocks
        elif tag == "br":
            parts.append(" ")
        elif tag not in VOID:
            if tag not in INLINE and any(opened.get(t) for t in ("p", *CLOSES.get(tag, ()))):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                        close(k)
                    elif stack[k][0] in SCOPES:
                        break
            words = ""
            attributes = m[3] or m[6] or ""
            if attributes and "=" in attributes or "hidden" in attributes:
                found = [(a.lower(), x or y or z) for a, x, y, z in _ATTRIBUTE.findall(attributes)]
                hidden = any(a == "hidden" or a == "aria-hidden" and v.lower() == "true" or a == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I) for a, v in found)
                words = " ".join(v for a, v in found if a in ("class", "id", "role")) + (" -hidden-" if hidden else "")
            above = stack[-1][1] if stack else None
            if tag not in INLINE:
                nodes += 1
                above = Node(tag, words, above, nodes)
            stack.append((tag, above))
            opened[tag] = opened.get(tag, 0) + 1
            silent += tag in SILENT
            links += tag == "a"
            if tag in RAW:
                stop = _RAW_END[tag].search(page, at)
                at = stop.start() if stop else n
    flush()
    return out


# ---------------------------------------------------------------- features

#: Words of class, id and role names that tell what a part of a page is for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs tabs toc pagination pager skip sitemap topbar toolbar menue navegacion navegação",
    "header": "header masthead banner logo branding site-title hero kopf kopfzeile entete cabecera",
    "footer": "footer foot colophon copyright legal imprint bottom credits fuss fusszeile impressum pied mentions pie",
    "side": "sidebar side aside rail widget related recommended recommendations popular trending more teaser teasers promoted seitenleiste verwandt lateral relacionados connexes",
    "notice": "cookie cookies consent gdpr notice notification alert warning banner popup modal overlay dialog privacy disclaimer paywall hinweis datenschutz avis aviso",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense commercial werbung anzeige publicite pub publicidad anuncio",
    "form": "form search login signin signup subscribe subscription newsletter register contact suche anmelden recherche buscar",
    "comments": "comment comments reply replies respond discussion disqus reader readers responses thread forum feedback kommentar kommentare antwort antworten leser commentaire commentaires reponse reponses comentario comentarios respuestas",
    "social": "share sharing social follow tweet facebook twitter",
    "meta": "meta byline author date published tags tag category categories caption",
    "hidden": "-hidden- hidden visually-hidden sr-only",
    "main": "article main content post entry story body text page-content article-body post-content entry-content",
}
#: How such parts often begin.
PHRASES = {
    "footer": ["&copy; example.com &middot;", "&copy; 2020 Example.", "All rights reserved.", "Privacy policy", "Powered by Example."],
    "notice": ["This site uses cookies.", "We value your privacy.", "By signing in you accept the terms of use."],
    "advert": ["Advertisement", "Sponsored:"],
    "social": ["Share this"],
    "side": ["Read more"],
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "figure", "figcaption", "ul", "ol", "li", "table", "td", "p", "h1", "h2", "h3", "blockquote", "pre", "dl", "dialog", "fieldset", "address")
_SPLIT = re.compile(r"[^a-z]+")


def _hints(words: str) -> set[str]:
    """Kinds that whole names tell, and as part:kind those that parts of compound names do."""
    whole = {_HINT[w] for w in words.lower().split() if w in _HINT}
    parts = {_HINT[w] for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower()) if w in _HINT}
    return whole | {f"part:{kind}" for kind in parts - whole}


def _names() -> list[str]:
    out = ["bias", "first", "last"]
    out += [f"in:{t}" for t in _TAGS] + [f"own:{t}" for t in _TAGS] + [f"{where}:{part}{h}" for where in ("hint", "near") for part in ("", "part:") for h in HINTS]
    out += [f"words:{k}" for k in range(6)] + [f"links:{k}" for k in range(4)] + ["stop", "no-article", "no-main"]
    out += [f"sentences:{k}" for k in range(3)] + [f"{side}:{k}" for side in ("before", "after") for k in range(4)]
    out += [f"{where}{cell}" for where in ("inside", "outside", "after-inside") for cell in ("", *(f":words:{k}" for k in range(6)), *(f":own:{t}" for t in ("p", "div", "li", "h2", "h3", "td")))]
    out += ["row", "long-row", "sole-article"] + [f"{who}:{k}" for who in ("twins", "outer-twins") for k in (2, 3, 4)]
    return out


NAMES = _names()
_INDEX = {name: k for k, name in enumerate(NAMES)}
_kinds: dict[tuple[str, str], tuple[frozenset[int], frozenset[int]]] = {}


def _kind(node: Node) -> tuple[frozenset[int], frozenset[int]]:
    """Features that an element gives to all blocks in it, and to those close below it; pages repeat the same ones."""
    key = node.tag, node.words
    if key not in _kinds:
        if len(_kinds) > 20_000:
            _kinds.clear()
        found = _hints(node.words) if node.words else set()
        wide = {f"in:{node.tag}"} | ({f"hint:{h}" for h in found} if node.tag not in ("html", "body") else set())
        _kinds[key] = tuple(frozenset(_INDEX[x] for x in on if x in _INDEX) for on in (wide, {f"near:{h}" for h in found}))
    return _kinds[key]


def _scope(node: Node | None) -> list[int]:
    """Features of the elements around a block."""
    if node is None:
        return []
    chain = []
    at: Node | None = node
    while at is not None and at.around is None:
        chain.append(at)
        at = at.parent
    for below in reversed(chain):
        above, own = below.parent.around if below.parent else frozenset(), _kind(below)[0]
        below.around = above if own <= above else above | own
    near = _kind(node)[1] | (_kind(node.parent)[1] if node.parent else frozenset())
    own = f"own:{node.tag}"
    return [*node.around, *near, *([_INDEX[own]] if own in _INDEX else [])]


_ENDS = re.compile(r"[.!?。！？…](?:[\"'”»)\]}]*(?:\s|$))")
_WIDTHS = (2, 5, 10, 20, 50)
TELLING_WORDS = 12  # in sentences, that an element must hold to be told from others by them


def _tree(blocks: list) -> list[Node]:
    """The elements around the blocks, children before their parents."""
    seen: dict[int, Node] = {}
    for node, *_ in blocks:
        while node is not None and node.number not in seen:
            seen[node.number] = node
            node = node.parent
    return [seen[k] for k in sorted(seen, reverse=True)]


def _holder(blocks: list, tree: list[Node], weights: list[int]) -> Node | None:
    """The deepest element around blocks that holds more than half of the page's sentences, by words; none where that is too little to tell."""
    held: dict[int, int] = {}
    for (node, *_), w in zip(blocks, weights, strict=True):
        if w and node is not None and node.parent is not None:
            held[node.parent.number] = held.get(node.parent.number, 0) + w
    for node in tree:
        if node.parent is not None and node.number in held:
            held[node.parent.number] = held.get(node.parent.number, 0) + held[node.number]
    total = sum(weights)
    return max((n for n in tree if n.tag not in ("html", "body") and 2 * held.get(n.number, 0) > total and held[n.number] >= TELLING_WORDS), key=lambda n: n.depth, default=None)


def block_features(blocks: list) -> list[list[int]]:
    """Indices of the features that are on, for each block."""
    tree = _tree(blocks)
    tags = {n.tag for n in tree}
    page = [_INDEX[x] for x, off in (("no-article", "article" not in tags), ("no-main", not tags & {"main", "article"})) if off]
    words = [text.count(" ") + 1 for _, text, _ in blocks]
    share = [linked / len(text) for _, text, linked in blocks]
    ends = [len(_ENDS.findall(text)) for _, text, _ in blocks]
    holder = _holder(blocks, tree, [w if e and w >= 4 and s < 0.5 else 0 for w, e, s in zip(words, ends, share, strict=True)])
    within: dict[int, bool] = {}
    alike: dict[tuple, int] = {}
    for n in reversed(tree):
        within[n.number] = n is holder or n.parent is not None and within[n.parent.number]
        kind = (n.parent.number if n.parent else 0, n.tag, n.words)
        alike[kind] = alike.get(kind, 0) + 1
    twins = lambda n: 0 if n is None else min(4, alike[n.parent.number if n.parent else 0, n.tag, n.words])
    articles = [n for n in tree if n.tag == "article"]
    sole: dict[int, bool] = {}
    for n in reversed(tree):
        sole[n.number] = len(articles) == 1 and (n is articles[0] or n.parent is not None and sole[n.parent.number])
    inside = [node is not None and within[node.number] for node, *_ in blocks]
    last = max((k for k, x in enumerate(inside) if x), default=-1)
    rows: dict[int, int] = {}
    place = lambda node: node.parent.number if node is not None and node.parent is not None else 0
    for (node, *_), w in zip(blocks, words, strict=True):
        if w <= 5:
            rows[place(node)] = rows.get(place(node), 0) + 1
    width = lambda k: 3 if not 0 <= k < len(blocks) else 0 if words[k] <= 3 else 1 if words[k] <= 12 else 2
    out = []
    for k, (node, text, _) in enumerate(blocks):
        on = [0, *_scope(node), *page]
        on.append(_INDEX[f"words:{sum(words[k] > x for x in _WIDTHS)}"])
        on.append(_INDEX[f"links:{0 if share[k] == 0 else 1 if share[k] < 0.3 else 2 if share[k] < 0.8 else 3}"])
        on.append(_INDEX[f"sentences:{min(ends[k], 2)}"])
        on += [_INDEX[f"before:{width(k - 1)}"], _INDEX[f"after:{width(k + 1)}"]]
        if holder is not None:
            where = "inside" if inside[k] else "after-inside" if k > last else "outside"
            cells = (where, f"{where}:words:{sum(words[k] > x for x in _WIDTHS)}", f"{where}:own:{node.tag if node else ''}")
            on += [_INDEX[x] for x in cells if x in _INDEX]
        if node is not None and sole[node.number]:
            on.append(_INDEX["sole-article"])
        if words[k] <= 5 and (n := rows[place(node)]) > 1:
            on.append(_INDEX["row" if n <= 4 else "long-row"])
        if text.rstrip(")]}")[-1:] in tuple(".!?:;\"'”»…。"):
            on.append(_INDEX["stop"])
        # Elements of one kind side by side: the list items, table cells or comments that the block is in one of.
        for who, box in (("twins", node.parent if node else None), ("outer-twins", node.parent.parent if node and node.parent else None)):
            if (n := twins(box)) > 1:
                on.append(_INDEX[f"{who}:{n}"])
        if k == 0:
            on.append(1)
        if k == len(blocks) - 1:
            on.append(2)
        out.append(on)
    return out


# --------------------------------------------------------------------- CRF


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Crf:
    """Two labels (0 other, 1 main); weights of features by label and of transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def emissions(self, features: list[list[int]]) -> np.ndarray:
        flat = np.array([x for on in features for x in on])
        bounds = np.cumsum([0] + [len(on) for on in features])[:-1]
        return np.add.reduceat(self.weights[flat], bounds, axis=0)

    def decode(self, features: list[list[int]]) -> list[int]:
        """The likeliest labels, by Viterbi; of equal paths the one with less main."""
        e, back = self.emissions(features).tolist(), []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = e[0]
        for x, y in e[1:]:
            from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            back.append((from0, from1))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        path = [1 if b > a else 0]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    @staticmethod
    def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 250, decay: float = 0.0001, rate: float = 0.1) -> Crf:
        """Maximum likelihood with a quadratic penalty, by Adam on the exact gradient."""
        size = max(len(f) for f, _ in pages)
        n = len(pages)
        x = np.zeros((n, size, len(NAMES)), np.float32)
        y, mask = np.zeros((n, size), int), np.zeros((n, size), bool)
        for k, (features, labels) in enumerate(pages):
            for t, on in enumerate(features):
                x[k, t, on] += 1
            y[k, : len(labels)], mask[k, : len(labels)] = labels, True
        total = mask.sum()
        gold = np.eye(2)[y] * mask[:, :, None]
        gold_w = np.einsum("ktf,ktl->fl", x, gold)
        gold_m = np.einsum("kta,ktb->ab", gold[:, :-1], gold[:, 1:])
        weights, moves = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
        state = [[np.zeros_like(weights)] * 2, [np.zeros_like(moves)] * 2]
        for step in range(1, rounds + 1):
            e = x @ weights
            ahead, behind = np.zeros((n, size, 2)), np.zeros((n, size, 2))
            ahead[:, 0] = e[:, 0]
            for t in range(1, size):
                ahead[:, t] = np.where(mask[:, t, None], _log_sum(ahead[:, t - 1, :, None] + moves[None], 1) + e[:, t], ahead[:, t - 1])
            for t in range(size - 2, -1, -1):
                behind[:, t] = np.where(mask[:, t + 1, None], _log_sum(moves[None] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
            z = _log_sum(ahead[:, -1], 1)
            single = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
            pair = np.exp(ahead[:, :-1, :, None] + moves + (e + behind)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            grads = [(np.einsum("ktf,ktl->fl", x, single) - gold_w) / total + decay * weights, (pair.sum((0, 1)) - gold_m) / total + decay * moves]
            for value, grad, s in zip((weights, moves), grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * grad
                s[1] = 0.999 * s[1] + 0.001 * grad**2
                value -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        return Crf(weights, moves)


# ---------------------------------------------------------- labelled pages


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Training pages of many layouts: html and the label of each leaf block. Words are invented, layouts are common ones."""
    rng = random.Random(seed)
    syllables = "ba co di fe gu ha lo mi ne pu ra si to vu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])
    pick = rng.choice
    pages = []
    for _ in range(count):
        out: list[str] = []
        labels: list[int] = []

        def put(text: str, label: int, out=out, labels=labels) -> None:
            out.append(text)
            labels.append(label)

        def told(kind: str) -> str:
            """A name that tells the kind, or one that tells nothing, as in languages that no list has."""
            return f'{pick(["", "site-", "page-", "box "])}{pick(HINTS[kind].split())}' if kind not in ("comments", "side", "footer") or rng.random() < 0.6 else f"{word()}{pick(['', '-', ' '])}{pick(['', word()])}"

        def named(kind: str) -> str:
            return "" if rng.random() < 0.35 else f' {pick(["class", "class", "id"])}="{told(kind)}"'

        def menu() -> None:
            tag = pick(["nav", "nav", "div", "ul"])
            out.append(f"<{tag}{named('menu') if tag != 'div' else ' class=menu'}><ul>")
            for _ in range(rng.randint(2, 8)):
                put(f'<li><a href="/{word()}">{words(1, 3)}</a></li>', 0)
            out.append(f"</ul></{tag}>")

        def header() -> None:
            tag = pick(["header", "div"])
            out.append(f"<{tag}{named('header') if tag == 'header' else ' class=header'}>")
            put(f"<{pick(['div', 'p', 'h2'])}>{words(1, 5)}</div>", 0)
            if rng.random() < 0.5:
                menu()
            out.append(f"</{tag}>")

        def box(kind: str, tags: list[str], low: int, high: int, many: int) -> None:
            tag = pick(tags)
            name = named(kind) if tag not in ("div", "section", "p") else f' class="{pick(HINTS[kind].split()) if kind != "footer" else told(kind)}"'
            out.append(f"<{tag}{name}>")
            phrase = pick(["", "", *PHRASES[kind]]) if kind in PHRASES else ""
            if tag == "p" or rng.random() < 0.45:
                put(f"{phrase} {' '.join(sentence(low, high) for _ in range(rng.randint(1, 2)))}", 0)
            else:
                if rng.random() < 0.3:
                    put(f"<h3>{words(1, 4)}</h3>", 0)
                for _ in range(rng.randint(1, many)):
                    text = " ".join([phrase, *(sentence(low, high) for _ in range(rng.randint(1, 3)))])
                    put(f'<p><a href="/{word()}">{text}</a></p>' if rng.random() < 0.3 else f"<p>{text}</p>", 0)
            out.append(f"</{tag}>")

        def form() -> None:
            out.append(f'<form{named("form")} action="/{word()}">')
            for _ in range(rng.randint(1, 3)):
                put(f"<{pick(['p', 'div', 'fieldset'])}><label>{words(1, 6)}</label><input name=q></p></div></fieldset>", 0)
            out.append("</form>")

        def advert() -> None:
            box("advert", ["div", "div", "aside", "section"], 2, 15, 2)

        def notice() -> None:
            box("notice", ["div", "div", "section", "aside", "dialog", "p"], 4, 25, 2)

        def comments() -> None:
            tag = pick(["section", "div", "ol", "ul"])
            name = f' {pick(["class", "id"])}="{told("comments")}{pick(["", "", "-list", "-area"])}"'
            out.append(f"<{tag}{name}>")
            entry, by = pick(["div", "div", "li", "article", "article", "blockquote"]), pick(["", "b", "span", "h4", "div"])
            kind = pick(["", "", " class=comment", " class=reply", f" class={word()}"])
            if rng.random() < 0.6:
                put(f"<h{pick('234')}>{words(1, 3)}</h4>", 0)
            for _ in range(rng.randint(1, 5)):
                text = " ".join(sentence(2, 12) for _ in range(pick([1, 1, 2, 3])))
                out.append(f"<{entry}{kind}>")
                if by:
                    put(f"<{by}>{words(1, 2)}</{by}>", 0)
                put(f"<p>{text}</p>", 0)
                out.append(f"</{entry}>")
            if rng.random() < 0.3:
                form()
            out.append(f"</{tag}>")

        def teasers() -> None:
            tag, inner = pick(["section", "div", "aside"]), pick(["div", "li", "article"])
            out.append(f"<{tag}{named('side')}>")
            if rng.random() < 0.7:
                put(f"<h{pick('23')}>{words(1, 4)}</h3>", 0)
            kind = pick(["", f" class={word()}"])
            for _ in range(rng.randint(2, 6)):
                out.append(f"<{inner}{kind}>")
                put(f"<{pick(['h3', 'p', 'div'])}><a href=/{word()}>{words(1, 6)}</a></p></h3></div>", 0)
                if rng.random() < 0.7:
                    put(f"<p>{sentence(3, 12)}</p>", 0)
                out.append(f"</{inner}>")
            out.append(f"</{tag}>")

        def article() -> None:
            wrap = pick(["article", "article", "article", "main", "div", "div", "section", ""])
            name = named("main") if wrap in ("article", "main") else f' class="{pick(HINTS["main"].split())}"'
            if wrap and rng.random() < 0.2:  # a name that tells nothing, or misleads
                other = f'{pick(HINTS[pick(["comments", "side", "notice", "advert", "meta", "form"])].split())}-{word()}'
                name = pick(["", f' class="{word()}"', f' class="{word()}-{word()}"', f' class="{other} {pick(HINTS["main"].split())}"', f' class="{other} {word()}"', f' id="{other}"'])
            if wrap:
                out.append(f"<{wrap}{name}>")
            if rng.random() < 0.85:
                top = rng.random() < 0.2
                out.append("<header>" if top else "")
                put(f"<h1>{pick(['', '<b>'])}{sentence(1, 14)}</h1>", 1)
                out.append("</header>" if top else "")
            terse = wrap == "article" and rng.random() < 0.2
            for k in range(rng.randint(1 if terse else 2, 14)):
                kind = rng.random()
                text = sentence(1, 3) if terse else " ".join(sentence(*pick([(1, 5), (5, 18), (8, 30)])) for _ in range(pick([1, 2, 2, 4, 8])))
                if rng.random() < 0.15:
                    text += f' <a href="/{word()}">{words(1, 3)}</a> {sentence(2, 9)}'
                if kind < 0.72:
                    put(f"<p{pick(['', '', f' class={word()}'])}>{pick(['', '', '', '<b>', '<em>'])}{text}{pick(['</p>', '</p>', '', '<br>'])}", 1)
                elif kind < 0.80:
                    put(f"<h{pick('23')}>{sentence(1, 8)}</h3>", 1)
                elif kind < 0.86:
                    put(f"<blockquote>{text}</blockquote>", 1)
                elif kind < 0.92:
                    out.append("<ul>")
                    for _ in range(rng.randint(1, 4)):
                        put(f"<li>{sentence(1, 12)}</li>", 1)
                    out.append("</ul>")
                elif kind < 0.95:
                    out.append("<table><tr>")
                    for _ in range(rng.randint(1, 4)):
                        put(f"<td>{words(1, 6)}</td>", 1)
                    out.append("</tr></table>")
                else:
                    put(f"<div>{text}</div>", 1)
                if k and rng.random() < 0.15:
                    pick([advert, notice, lambda: box("side", ["aside"], 2, 8, 3), lambda: box("social", ["div"], 1, 3, 2)])()
            if rng.random() < 0.1:
                comments()
            if wrap:
                out.append(f"</{wrap}>")

        out.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        for part, chance in ((notice, 0.2), (header, 0.5), (menu, 0.7), (advert, 0.5), (notice, 0.15)):
            if rng.random() < chance:
                part()
        if rng.random() < 0.25:
            box("side", ["aside", "aside", "div", "section"], 2, 14, 4)
        article()
        for part, chance in ((comments, 0.4), (teasers, 0.25), (form, 0.2), (advert, 0.2), (lambda: box("side", ["aside", "aside", "div", "section"], 2, 14, 4), 0.4), (menu, 0.1), (notice, 0.1)):
            if rng.random() < chance:
                part()
        if rng.random() < 0.85:
            box("footer", ["footer", "footer", "footer", "div"], 2, 14, 3)
        out.append(pick(["</body></html>", ""]))
        pages.append(("".join(out), labels))
    return pages


_models: dict[tuple, Crf] = {}


def trained(count: int = 400, seed: int = 7) -> Crf:
    """The model of labelled_pages, made once a process."""
    if (count, seed) not in _models:
        pages = []
        for page, labels in labelled_pages(count, seed):
            blocks = leaf_blocks(page)
            if len(blocks) == len(labels):
                pages.append((block_features(blocks), labels))
        _models[count, seed] = Crf.train(pages)
    return _models[count, seed]


def main_text(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    labels = model.decode(block_features(blocks))
    return "\n".join(text for (_, text, *_), keep in zip(blocks, labels, strict=True) if keep)


def _extract(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page: its main blocks, joined by line feeds.

    Character references are decoded and white space inside a block is one
    space; blocks are never cut. Null and empty pages, and pages without main
    blocks, give an empty text. One row for each row of pages, repeated or not;
    null ids and urls stay null; other columns are ignored.
    """
    lean(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract(model or trained()), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all of pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
