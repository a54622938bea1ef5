"""Leaf blocks of HTML pages: runs of text between the edges of block elements.

A small reading of the markup as browsers do it: comments, scripts and other raw text
fall out, character references are decoded, end tags that may be left out are implied,
stray ones are ignored, and a page may break off anywhere. Every step is linear in the
page, also for broken or deeply nested markup.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names of HTML by how they are read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
OUTER = frozenset(["html", "head", "body"])
LANDMARKS = frozenset("article main nav header footer aside form".split())
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends open elements (first) unless one of the others was opened since.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
# Usual names of containers on web pages, by what they hold.
NAMES = {
    "main": "content article post entry entry-content story story-body article-body post-content main-content text "
    "page-content articleBody body-text inhalt contenu contenido",
    "menu": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager toc tabs skip-links",
    "header": "header site-header masthead topbar page-header branding logo kopfzeile cabecera",
    "footer": "footer site-footer page-footer colophon copyright legal contentinfo fusszeile impressum",
    "sidebar": "sidebar aside widget widget-area related related-posts recommended popular trending teaser teasers "
    "complementary tags archive blogroll rail lateral sidebar-right",
    "notice": "notice cookie cookie-notice cookies consent gdpr alert popup modal overlay paywall message disclaimer "
    "toast hint dialog warning announcement",
    "advert": "ad ads advert adverts advertisement ad-slot adsense sponsor sponsored promo promotion banner-ad "
    "advertising werbung anzeige publicite publicidad",
    "form": "form search search-form newsletter subscribe signup login contact-form searchbox register",
    "comments": "comments comment comment-list commentlist comment-body reply respond responses discussion disqus "
    "replies user-comments reader-comments kommentare commentaires comentarios",
    "share": "share social share-buttons sharing social-media follow toolbar print",
}
NAMES = {kind: tuple(names.split()) for kind, names in NAMES.items()}
#: What an element of such a name holds.
_KIND = {name.lower(): kind for kind, names in NAMES.items() for name in names if "-" not in name}
_PARAGRAPH = ("p",), ("td", "th", "caption", "button")
_CELLS = ("td", "th", "caption", "table")
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>
    |</?[a-zA-Z][^>]*+\Z
    |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I
)
_NAME = re.compile(r"[^\W\d_]+")
#: Layout words say what stands beside an element, not what it is.
_BESIDE = re.compile(r"\b(?:has|with|without|no)[-_]\w+", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Frame(NamedTuple):
    """An open element: its name, the ones around it, and what it adds to them."""

    tag: str
    parent: Frame | None
    added: tuple[str, ...]
    landmark: str
    #: Sum of the weights of what all open elements add.
    weight: float


class Block(NamedTuple):
    text: str
    #: Characters that aren't white space, and those of them in links.
    chars: int
    linked: int
    frame: Frame


def names_of(attributes: str) -> list[str]:
    """Words of the class, id and role of a tag, and whether it is hidden."""
    out = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = max(values, key=len)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.append("hidden")
        elif name == "style":
            if _HIDDEN.search(value):
                out.append("hidden")
        elif name != "aria-hidden":
            out.extend(w.lower() for w in _NAME.findall(_BESIDE.sub(" ", value)))
    return out


def blocks(page: str, weights: dict[str, float]) -> list[Block]:
    """The leaf blocks of a page in order; blocks of white space only are none."""
    frame = Frame("", None, (), "", 0.0)
    stack = [frame]
    open_at: dict[str, list[int]] = {}
    active: dict[str, int] = {}
    out: list[Block] = []
    held: list[str] = []
    chars = linked = 0
    in_link = False

    def flush() -> None:
        nonlocal chars, linked
        if chars:
            out.append(Block(" ".join("".join(held).split()), chars, linked, stack[-1]))
        held.clear()
        chars = linked = 0

    def hold(text: str) -> None:
        nonlocal chars, linked
        if "&" in text:
            text = html.unescape(text)
        held.append(text)
        n = sum(map(len, text.split()))
        chars += n
        linked += n * in_link

    def last(tags: tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(depth: int) -> None:
        """Leave the elements from this depth on."""
        while len(stack) > depth:
            gone = stack.pop()
            open_at[gone.tag].pop()
            for feature in gone.added:
                active[feature] -= 1

    def start(tag: str, attributes: str) -> None:
        if tag in PARAGRAPH_ENDS and last(_PARAGRAPH[0]) > last(_PARAGRAPH[1]):
            close(last(_PARAGRAPH[0]))
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            if last(ends) > last(bounds):
                close(last(ends))
        if tag in VOID:
            return
        above = stack[-1]
        features = {"a:" + tag}
        if attributes:
            names = names_of(attributes)
            features.update("c:" + n for n in names)
            features.update("g:" + _KIND[n] for n in names if n in _KIND)
        added = tuple(sorted(f for f in features if not active.get(f)))
        for feature in added:
            active[feature] = active.get(feature, 0) + 1
        landmark = f"{above.landmark.rpartition('>')[2]}>{tag}" if tag in LANDMARKS else above.landmark
        weight = above.weight + sum(weights.get(f, 0.0) for f in added)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(Frame(tag, above, added, landmark, weight))

    def end(tag: str) -> None:
        depth = last((tag,))
        if depth and (tag in _TABLE or depth > last(_CELLS)):
            flush()
            close(depth)
        elif tag == "p":
            # A stray end of a paragraph stands for an empty one.
            flush()

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        begin = token.start() if token else len(page)
        if begin > at:
            hold(page[at:begin])
        if not token:
            break
        at = token.end()
        if not token["name"]:
            continue
        tag = token["name"].lower()
        if tag == "a":
            in_link = not token["end"]
        elif tag == "br":
            held.append(" ")
        elif tag in RAW and not token["end"]:
            closing = _RAW_END[tag].search(page, at)
            at = closing.end() if closing else len(page)
        elif tag not in INLINE and tag not in OUTER and (tag not in VOID or tag == "hr"):
            if token["end"]:
                end(tag)
            else:
                flush()
                start(tag, token["rest"])
    flush()
    return out


# --- features ------------------------------------------------------------------

#: Words that say what a short block is for.
CUES = frozenset(
    "ad advertisement advertising sponsored cookie cookies consent privacy policy terms copyright rights reserved "
    "subscribe newsletter login register sign comments comment reply share follow menu search home contact imprint "
    "werbung anzeige datenschutz impressum publicité commentaires publicidad comentarios".split()
)
_CUE_WORDS = 15


def _level(value: float, limits: tuple[float, ...]) -> int:
    return sum(value >= x for x in limits)


def text_features(block: Block) -> tuple[str, ...]:
    """Length, links, ending and signs of a block's text, with its element."""
    text = block.text
    parts = text.split(" ")
    size = _level(len(parts), (3, 6, 13, 31))
    link = _level(block.linked / block.chars, (0.01, 0.3, 0.9))
    ends = "." if text[-1] in ".!?…:;\"”»" else "-"
    features = [f"n{size}", f"k{link}", f"n{size}k{link}", f"e{ends}n{size}", f"t:{block.frame.tag}k{link}"]
    if "©" in text:
        features.append("copy")
    if " | " in text or " · " in text or " » " in text:
        features.append(f"bar{size}k{link}")
    if len(parts) <= _CUE_WORDS:
        features.extend({"w:" + w for p in parts if (w := p.strip(".,:;!?()").lower()) in CUES})
    return tuple(features)


def own_features(frame: Frame) -> tuple[str, str]:
    return "t:" + frame.tag, "l:" + frame.landmark


def features(block: Block) -> list[str]:
    """Everything that speaks for or against a block."""
    out = [*own_features(block.frame), *text_features(block)]
    frame = block.frame
    while frame is not None:
        out.extend(frame.added)
        frame = frame.parent
    return out


def score(block: Block, weights: dict[str, float]) -> float:
    """Sum of the weights of a block's features."""
    total = block.frame.weight
    for feature in own_features(block.frame):
        total += weights.get(feature, 0.0)
    for feature in text_features(block):
        total += weights.get(feature, 0.0)
    return total
