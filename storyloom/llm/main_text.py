"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between the starts and ends of block-level elements. A block's features are
its ancestors' tags, the words of their class, id and role attributes, the shape of its text, what its innermost container
holds as a whole (words, share of links, part of the page), and its neighbours. The field has two
labels (main text or not) with weights for features, label pairs and the first label. It is trained by gradient ascent
of the conditional likelihood (forward-backward) on labelled pages, and a page is decoded by Viterbi.

The labelled pages come from ``labelled_pages``: layouts of its own making with the label of every block, as the engine
ships no corpus; other pages can be passed in. Training takes seconds and happens once on the driver.

Half of these pages tell nothing by their elements and names, so that the field does not need either.

Defined results: null or empty html, or none that is main text, gives the empty text. Of equal scores a block stays out. Unclosed and stray tags are
handled as browsers do in the common cases (implied ends of p, li, td and the like; unknown ends are ignored). A comment or
an element without text that nothing closes does not take the rest of the page with it, except script and style.
Rows of equal or null id are separate rows. Columns other than the key, the url and the html are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements whose content is never text of the page; those that a slash at the end of their tag makes empty; those that
#: reach to the end of the page if nothing closes them (of others without an end only the tag goes).
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video title select".split())
FOREIGN, TO_THE_END = ("svg", "math"), ("script", "style")
#: A start tag of the key ends an open element of the value (up to a container).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
CONTAINERS = frozenset("html body div article main section aside nav header footer form table ul ol dl blockquote td th".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Declarations, and tags that are cut short or have an open quote.
_OTHER = re.compile(r"<[/!?a-zA-Z][^>]*+>?")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAGS = frozenset("a article main section nav header footer aside form button label fieldset li ul ol dl dd table td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address summary details dialog menu caption body head center".split())
#: Attribute words with a feature of their own; others give none.
_NAMES = frozenset(
    "content article post entry story main body text page nav navigation navbar menu header head masthead banner footer foot copyright legal sidebar side widget aside ad ads advert advertisement promo promotion sponsor sponsored "
    "cookie cookies consent notice alert gdpr privacy popup modal overlay dialog comment comments reply replies respond discussion disqus thread share sharing social related recommended recommendations more newsletter subscribe subscription signup login form search "
    "breadcrumb breadcrumbs crumbs pagination pager tags tag meta byline author date toolbar skip top bottom logo brand complementary contentinfo links list archive hidden hide none articlebody blog title headline caption figure table quote code lead intro summary".split()
)


#: Ancestors of blocks that belong to the text, and of blocks that stand apart from it even there.
_WITHIN = frozenset("<article> <main> @article @articlebody @post @entry @story @content".split())
_APART = frozenset("<nav> <header> <footer> <aside> <form> <button> <dialog> <menu> @nav @navigation @navbar @menu @sidebar @side @widget @aside @ad @ads @advert @advertisement @promo @promotion @sponsor @sponsored @cookie @consent @notice @alert @gdpr @popup @modal @comment @comments @reply @replies @respond @discussion @share @social @related @recommended @newsletter @signup @login @form @search @breadcrumb @breadcrumbs @pagination @footer @masthead @banner @copyright @legal @invisible".split())


#: Elements that group blocks: what a group holds as a whole says more than its markup.
_GROUPS = CONTAINERS - {"td", "th"}
_SIZES = (2, 5, 10, 20, 50)


@dataclass
class Block:
    text: str
    features: tuple[str, ...]
    group: int = 0
    linked: int = 0


def _size(words: int) -> str:
    return next((f"<{n}" for n in _SIZES if words < n), "50+")


def _linked(share: float) -> str:
    return "all" if share > 0.8 else "part" if share > 0.3 else "little" if share > 0 else "none"


def _add_context(page: list[Block]) -> None:
    """Features of the block's group (its innermost container, then that one's), of its neighbours, and of its place."""
    n = len(page)
    words = [b.text.count(" ") + 1 for b in page]
    shares = [_linked(b.linked / len(b.text)) for b in page]
    sums: dict[int, list[int]] = {}
    for b, w in zip(page, words):
        total = sums.setdefault(b.group, [0, 0, 0, 0])
        for k, x in enumerate((1, w, b.linked, len(b.text))):
            total[k] += x
    plain = {g: t[1] * (1 - t[2] / t[3]) for g, t in sums.items()}
    most = max(plain.values(), default=0)
    for i, b in enumerate(page):
        count, total, linked, chars = sums[b.group]
        group = _linked(linked / chars)
        size = "<15" if total < 15 else "<40" if total < 40 else "<100" if total < 100 else "<300" if total < 300 else "300+"
        part = plain[b.group] / most if most else 0.0
        rank = "most" if part == 1 else "much" if part > 0.4 else "some" if part > 0.1 else "few"
        own = [f"group words {size}", f"group linked {group}", f"group holds {rank}", f"group of {'1' if count < 2 else '3' if count < 4 else '4+'}", f"{_size(words[i])} in {rank} {group}", f"{shares[i]} in {group} {rank}"]
        for side, j in (("before", i - 1), ("after", i + 1)):
            own.append(f"{side}: {_size(words[j])} {shares[j]} {'inside' if page[j].group == b.group else 'outside'}" if 0 <= j < n else f"{side}: none")
        own += ["first tenth"] if i * 10 < n else ["last tenth"] if (n - 1 - i) * 10 < n else []
        b.features += tuple(own)


def _attribute_features(attributes: str) -> set[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found.add("@invisible")
        elif name in ("class", "id", "role", "itemprop"):
            found |= {f"@{w}" for w in map(str.lower, _WORD.findall(value)) if w in _NAMES}
    return found


def _text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    size = "1" if words < 2 else "4" if words < 5 else "9" if words < 10 else "19" if words < 20 else "49" if words < 50 else "50+"
    share = linked / len(text)
    out = [f"words {size}", "linked all" if share > 0.8 else "linked part" if share > 0.3 else "linked little" if share > 0 else "linked none"]
    if text[-1] in ".!?:;…\"”»'":
        out.append("ends as a sentence")
    if text[0] in "©" or "©" in text or "copyright" in text[:200].lower() or "all rights reserved" in text[-200:].lower():
        out.append("copyright")
    if words > 4 and text.count(",") + text.count(".") > words / 25:
        out.append("punctuated")
    if text.count("|") + text.count("»") + text.count("›") > 2:
        out.append("separators")
    return out


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """What is no text of a page, in order: its begin and end, and of tags the name, whether an end tag, and the attributes.

    The name is empty for comments, declarations and whole elements that hold no text. Time is linear in the page: what is
    once not found ahead is not looked for again.
    """
    at, missing = 0, set()
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            close = -1 if "--" in missing else html.find("-->", start + 2)
            if close < 0:  # a comment without an end goes as far as the next tag's
                missing.add("--")
                close = html.find(">", start)
                at = len(html) if close < 0 else close + 1
            else:
                at = close + 3
            yield start, at, "", False, ""
        elif m := _TAG.match(html, start):
            name, end = m[2].lower(), bool(m[1])
            at = m.end()
            if name not in RAW or end:
                yield start, at, name, end, m[3]
                continue
            if not (name in FOREIGN and m[3].endswith("/")):
                close = None if name in missing else _END[name].search(html, at)
                if close:
                    at = close.end()
                else:
                    missing.add(name)
                    at = len(html) if name in TO_THE_END else at
            yield start, at, "", False, ""
        elif m := _OTHER.match(html, start):
            at = m.end()
            yield start, at, "", False, ""
        else:
            at = start + 1


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in page order, each with its features."""
    out: list[Block] = []
    # of each open element: its name, the features of its text, whether it is in a link, the innermost p up to a container, its group
    stack: list[tuple[str, frozenset[str], bool, int, int]] = [("", frozenset(), False, 0, 0)]
    groups = 0
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = at = 0

    def put(piece: str) -> None:
        nonlocal linked
        pieces.append(unescape(piece) if "&" in piece else piece)
        if stack[-1][2]:
            linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(Block(text, (*stack[-1][1], *_text_features(text, linked)), stack[-1][4], min(linked, len(text))))
            linked = 0

    def close(i: int) -> None:
        opened.subtract(e[0] for e in stack[i:])
        del stack[i:]

    for start, end, name, closes, attributes in tags(html):
        if start > at:
            put(html[at:start])
        at = end
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            flush()
        elif name == "br":
            pieces.append(" ")
        if closes:
            for i in range(len(stack) - 1 if opened[name] else 0, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if inline and stack[i][0] in CONTAINERS:
                    break
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        ends = ENDS.get(name)
        if ends and (opened["p"] or any(opened[e] for e in ends)):
            for i in range(len(stack) - 1, 0, -1):
                open_ = stack[i][0]
                if open_ == "p" or open_ in ends:
                    close(i)
                elif open_ in CONTAINERS and open_ not in ("td", "th"):
                    break
        elif not inline and not ends and stack[-1][3]:
            close(stack[-1][3])
        _, above, link, p, group = stack[-1]
        own = _attribute_features(attributes) if attributes else set()
        if name == "header" and above & _WITHIN and not above & _APART:
            own = {"<inner header>"}  # an article's own, with its headline
        elif name in _TAGS:
            own.add(f"<{name}>")
        if name in _GROUPS:
            groups += 1
            group = groups
        if own - above:
            above = (above | own) - {"within the text"}
            if above & _WITHIN and not above & _APART:
                above |= {"within the text"}
        opened[name] += 1
        stack.append((name, above, link or name == "a", len(stack) if name == "p" else 0 if name in CONTAINERS else p, group))
    if at < len(html):
        put(html[at:])
    flush()
    _add_context(out)
    return out


# --- labelled pages ---

_SYLLABLES = "ka lo mi ne ru ta vo se pi da ol en ir us am".split()


def _prose(r: random.Random, words: int, sentence: bool = True) -> str:
    own = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(words)]
    if sentence:
        for i in range(len(own)):
            if r.random() < 0.12:
                own[i] += r.choice(",.,.;")
        own[0] = own[0].capitalize()
        return " ".join(own).rstrip(",.;") + r.choice("...!?")
    return " ".join(own).title()


def labelled_pages(seed: int = 11, count: int = 700) -> Iterator[tuple[str, list[int]]]:
    """Pages of many layouts, each with the labels (1: main text) of its blocks in page order."""
    r = random.Random(seed)
    for _ in range(count):
        html: list[str] = []
        labels: list[int] = []
        # half of the pages tell nothing by their elements and names: plain ones, or ones whose names are made by a program
        telling = r.random() < 0.5
        semantic, named = telling and r.random() < 0.7, telling and r.random() < 0.75
        opaque = not telling and r.random() < 0.5

        def put(markup: str, label: int) -> None:
            html.append(markup)
            labels.append(label)

        def wrap(tag: str, names: list[str], own: bool = True) -> str:
            use = tag if semantic and own else "div"
            role = f' role="{r.choice(["navigation", "banner", "contentinfo", "complementary"])}"' if tag in ("nav", "header", "footer", "aside") and r.random() < 0.1 else ""
            kind = f' {r.choice(["class", "id"])}="{r.choice(names)}"' if telling and names and (named or use == "div") and r.random() < 0.9 else ""
            if opaque:
                kind = f' class="{r.choice(["css", "sc", "x", "q"])}-{r.randrange(16**6):06x}"'
            html.append(f"<{use}{kind}{role}>")
            return f"</{use}>"

        def links(n: int) -> None:
            form = r.choice(["li", "p", "div"])
            if form == "li":
                html.append("<ul>")
            long = r.random() < 0.4  # headlines of other pages
            for _ in range(n):
                label = _prose(r, r.randint(4, 14), r.random() < 0.5) if long else _prose(r, r.randint(1, 4), False)
                put(f'<{form}><a href="/{r.randint(1, 999)}">{label}{r.choice(["", "", "", "."]) if not long else ""}</a></{form}>', 0)
            if form == "li":
                html.append("</ul>")

        def menu() -> None:
            end = wrap("nav", ["nav", "main-menu", "navbar", "menu", "breadcrumbs", "site-navigation"])
            links(r.randint(2, 12))
            html.append(end)

        def header() -> None:
            end = wrap("header", ["header", "masthead", "site-header", "top-banner", "pageHeader"])
            put(f"<{(h := r.choice(['h1', 'div', 'p']))}>{_prose(r, r.randint(1, 4), False)}</{h}>", 0)
            if r.random() < 0.5:
                put(f"<p>{_prose(r, r.randint(4, 14))}</p>", 0)
            html.append(end)

        def footer() -> None:
            end = wrap("footer", ["footer", "site-footer", "legal", "copyright", "page-foot"])
            for _ in range(r.randint(1, 3)):
                text = r.choice(["&copy; ", "Copyright 2020 ", "", "&copy; 2021 &middot; "]) + _prose(r, r.randint(2, 30))
                put(text if r.random() < 0.3 and not labels[-1:] == [None] and html[-1] == "" else f"<p>{text}</p>", 0)
            html.append(end)

        def side() -> None:
            end = wrap("aside", ["sidebar", "widget", "related-posts", "recommended", "side"])
            put(f"<h3>{_prose(r, 2, False)}</h3>", 0)
            if r.random() < 0.6:
                links(r.randint(2, 5))
            else:
                put(f"<p>{_prose(r, r.randint(5, 40 if telling else 14))}</p>", 0)
            html.append(end)

        def advert() -> None:
            end = wrap("div", ["ad", "ads", "advert", "promo", "sponsored", "ad-banner", "cookie-notice", "notice", "gdpr-consent", "newsletter-signup", "popup", "alert", "share-buttons", "social"], False)
            text = _prose(r, r.randint(3, 45 if telling else 16))
            if not telling:
                text = f'{text} <a href="/x">{_prose(r, r.randint(1, 4), False)}</a>'
            put(text if r.random() < 0.6 else f"<p>{text}</p>", 0)
            html.append(end)

        def form() -> None:
            html.append(f'<form class="{r.choice(["search", "login", "contact", "signup"])}">' if telling else "<form>")
            put(f"<label>{_prose(r, r.randint(1, 5), False)}</label>", 0)
            html.append("<input name=q>")
            put(f"<button>{_prose(r, 1, False)}</button>", 0)
            html.append("</form>")

        def comments() -> None:
            end = wrap("section", ["comments", "comment-list", "replies", "discussion", "respond"])
            put(f"<h2>{_prose(r, 2, False)}</h2>", 0)
            for _ in range(r.randint(1, 4)):
                tag = r.choice(["div", "article", "li"]) if semantic else "div"
                html.append(f'<{tag} class="{r.choice(["comment", "reply", "comment-body"])}">')
                put(f"<p>{_prose(r, r.randint(3, 60))}</p>", 0)
                html.append(f"</{tag}>")
            html.append(end)

        def article() -> None:
            outer = wrap("main", ["main", "page", "content-wrap"]) if r.random() < 0.4 else ""
            end = wrap("article", ["article", "post", "entry-content", "post-body", "content", "story", "articleBody"])
            nested = 0 if telling else r.choice([0, 0, 1, 2])
            html.append("<div>" * nested)
            if r.random() < 0.8:
                inner = telling and r.random() < 0.15
                put(f"{'<header>' * inner}<h1>{_prose(r, r.randint(1, 9), r.random() < 0.5)}</h1>", 1)
                if inner and r.random() < 0.5:
                    put(f"<p>{_prose(r, r.randint(4, 20))}</p>", 1)
                html.append("</header>" * inner)
            for _ in range(r.randint(1 if telling else 3, 14)):
                kind, words = r.random(), r.choice([r.randint(1, 8), r.randint(8, 40), r.randint(30, 120)])
                text = _prose(r, words, r.random() < 0.9)
                if kind < 0.06:
                    put(f"<h2>{_prose(r, r.randint(1, 6), False)}</h2>", 1)
                elif kind < 0.12:
                    put(f"<blockquote><p>{text}</p></blockquote>", 1)
                elif kind < 0.17:
                    html.append("<ul>")
                    for _ in range(r.randint(2, 4)):
                        put(f"<li>{_prose(r, r.randint(2, 20))}</li>", 1)
                    html.append("</ul>")
                elif kind < 0.20:
                    put(f"<pre>{text}</pre>", 1)
                elif kind < 0.23:
                    html.append("<table><tr>")
                    for _ in range(3):
                        put(f"<td>{_prose(r, r.randint(1, 5), False)}</td>", 1)
                    html.append("</tr></table>")
                elif kind < 0.26:
                    put(f"<figure><img src=x><figcaption>{_prose(r, r.randint(2, 12))}</figcaption></figure>", 1)
                elif kind < 0.30:
                    r.choice([advert, side, form])()
                elif kind < 0.32:
                    put(f"<p>{' | '.join(text.split())} |</p>", 1)
                elif kind < 0.34:
                    put(f"<p>{' '.join(w + r.choice(['$$$', '###', '&amp;&amp;', '%%']) for w in text.split())}</p>", 1)
                elif kind < 0.36:
                    put(f"<p>{r.choice(['All rights reserved.', 'Copyright 2020.', _prose(r, 3), text.upper()])}</p>", 1)
                elif kind < 0.5:
                    put(f'<p>{_prose(r, 5)} <a href="/x">{_prose(r, 2, False)}</a> {text}</p>', 1)
                elif kind < 0.6:
                    put(f"<p><b>{text}<br>", 1)
                else:
                    put(f"<p>{text}" + r.choice(["</p>", "</p>", ""]), 1)
            html.append("</div>" * nested + end + outer)

        before = r.sample([menu, header, advert, form, side], r.randint(0, 4))
        # without names, readers' comments look as the text does
        after = r.sample([*([comments] if telling else []), side, advert, menu, form], r.randint(0, 3))
        for part in [*before, article, *after, *([footer] if r.random() < 0.8 else [])]:
            part()
        page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{''.join(html)}" + r.choice(["</body></html>", ""])
        if len(blocks(page)) == len(labels):  # adjoining bare texts would be one block
            yield page, labels


# --- the field ---


@dataclass
class Field:
    """Weights of the label 1 against 0 by feature, of label pairs, and of a first label 1."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: float

    def labels(self, page: list[Block]) -> list[int]:
        """The likeliest labels by Viterbi."""
        get = self.weights.get
        (aa, ab), (ba, bb) = self.pairs.tolist()
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        for i, b in enumerate(page):
            score = sum(get(f, 0.0) for f in b.features)
            if i == 0:
                zero, one = 0.0, self.first + score
                continue
            from0, from1 = (zero + aa >= one + ba), (zero + ab >= one + bb)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            zero, one = (zero + aa if from0 else one + ba), (zero + ab if from1 else one + bb) + score
        if not page:
            return []
        out = [int(one > zero)]
        for pointers in reversed(back):
            out.append(pointers[out[-1]])
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 150, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Maximise the conditional likelihood of the labels, all pages at once, with running-moment steps."""
    cut = [blocks(html) for html, _ in pages]
    names = sorted({f for page in cut for b in page for f in b.features})
    index = {f: i for i, f in enumerate(names)}
    length = np.array([len(p) for p in cut])
    n, most = len(cut), int(length.max())
    at = np.concatenate([[i * most + t] * len(b.features) for i, page in enumerate(cut) for t, b in enumerate(page)]).astype(int)
    feature = np.array([index[f] for page in cut for b in page for f in b.features])
    gold = np.zeros((n, most), int)
    for i, (_, y) in enumerate(pages):
        gold[i, : len(y)] = y
    live = np.arange(most) < length[:, None]
    theta = np.zeros(len(names) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        w, pairs, first = theta[: len(names)], theta[-5:-1].reshape(2, 2), theta[-1]
        emit = np.zeros((n, most, 2))
        emit[:, :, 1] = np.bincount(at, w[feature], minlength=n * most).reshape(n, most)
        emit[:, 0, 1] += first
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, most):
            step_up = np.logaddexp.reduce(fwd[:, t - 1, :, None] + pairs, axis=1) + emit[:, t]
            fwd[:, t] = np.where(live[:, t, None], step_up, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            step_down = np.logaddexp.reduce(pairs + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(live[:, t + 1, None], step_down, 0.0)
        z = np.logaddexp(fwd[rows, length - 1, 0], fwd[rows, length - 1, 1])
        one = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None])
        gap = (gold - one) * live
        g = np.zeros_like(theta)
        g[: len(names)] = np.bincount(feature, gap.reshape(-1)[at], minlength=len(names))
        both = np.exp(fwd[:, :-1, :, None] + pairs + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        g[-5:-1] = (seen - both.sum(axis=(0, 1))).reshape(-1)
        g[-1] = gap[:, 0].sum()
        g -= ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * min(1.0, 40 / step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, theta[: len(names)].tolist())), theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))


def main_text(html: str, field: Field) -> str:
    """The main text's blocks in page order, two newlines between them."""
    page = blocks(html)
    return "\n\n".join(b.text for b, y in zip(page, field.labels(page)) if y)


_default: list[Field] = []


def default_field() -> Field:
    """The field trained on ``labelled_pages``, once in a process."""
    if not _default:
        _default.append(train(list(labelled_pages())))
    return _default[0]


def extract(pages: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(field or default_field())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                texts = [main_text(h or "", held.value) for h in batch.column(2).slice(i, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 64), batch.column(1).slice(i, 64), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(lambda b: tidied(run(b)), "page_id long, url string, text string, n_chars long")
