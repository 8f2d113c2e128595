"""Leaf blocks of a page: runs of text between block-level tags, with what stands above them."""

from __future__ import annotations

import html
import re
from collections import Counter

# Elements of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea")
#: Left out with all they hold if they are closed; else only the tag is. What a head holds is left out by itself, other content ends it.
HIDDEN = frozenset("noscript template iframe svg select title".split())
#: An opening tag of the first closes an open element of the second.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Block elements that close an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:/>|" + ATTRS + r"(?<=[\s\"'])/>|" + ATTRS + r">.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"
    r"|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>" + ATTRS + ")>",
    re.S | re.I,
)
EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "tags", "names", "linked")

    def __init__(self, text: str, tags: tuple[str, ...], names: tuple[str, ...], linked: int):
        self.text, self.tags, self.names, self.linked = text, tags, names, linked


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """Index of the closing token of each closed hidden element, by the index of its opening one."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        tag = (m.group("tag") or "").lower()
        if tag in HIDDEN:
            held = open_.setdefault(tag, [])
            if not m.group("close"):
                if not EMPTY.search(m.group("attrs")):
                    held.append(i)
            elif held:
                out[held.pop()] = i
    return out


def blocks(page: str) -> list[Block]:
    """The non-empty blocks in page order; character references decoded, white space joined and trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), linked))
        held.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if in_link:
                linked += len(piece)

    tokens = list(TOKEN.finditer(page))
    ends = _ends(tokens)
    until = -1  # the token that closes a hidden element
    for i, m in enumerate(tokens):
        if i <= until:
            at = m.end()
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            until = ends.get(i, -1) if not m.group("close") else -1
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m.group("close") else 1
            elif tag == "br":
                held.append(" ")
            continue
        flush()
        in_link = 0
        if m.group("close"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else ())
        while stack and stack[-1][0] in shut:
            stack.pop()
        if tag in VOID or m.group("attrs").endswith("/"):
            continue
        names = tuple(n for a in ATTR.findall(m.group("attrs")) for n in NAME.findall("".join(a).lower())) if m.group("attrs") else ()
        stack.append((tag, names))
    add(page[at:])
    flush()
    return out


WORDS = re.compile(r"[^\W\d_]+")
# Words that speak for a kind of boilerplate.
CUES = {
    "cookie": "cookie cookies consent gdpr", "rights": "copyright rights reserved", "login": "login log sign register password username subscribe newsletter email",
    "share": "share tweet facebook twitter instagram follow", "advert": "advertisement sponsored promoted ad ads buy offer", "comment": "comment comments reply replies posted commented says wrote",
    "menu": "home about contact privacy terms sitemap menu search skip", "related": "related popular recommended trending read more latest",
}
CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}


def _bucket(n: float, cuts: tuple[float, ...]) -> int:
    return sum(n >= c for c in cuts)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block, from its text, the tags above it and its place."""
    out = []
    n = len(page)
    long = [len(b.text) for b in page]
    seen = Counter(b.tags[-1] if b.tags else "" for b in page)
    for i, b in enumerate(page):
        t = b.text
        words = t.split()
        size = _bucket(len(words), (2, 4, 8, 15, 30, 60))
        links = _bucket(b.linked / max(1, len(t)), (0.05, 0.3, 0.6, 0.95))
        leaf = b.tags[-1] if b.tags else "-"
        f = ["1", f"size{size}", f"link{links}", f"leaf:{leaf}", f"leaf:{leaf}/size{size}", f"end:{t[-1] if t[-1] in '.!?:,|' else 'x'}", f"from{_bucket(i, (1, 2, 4, 8))}", f"left{_bucket(n - 1 - i, (1, 2, 4, 8))}"]
        f += [f"above:{x}" for x in set(b.tags)]
        f += [f"name:{x}" for x in set(b.names)]
        f.append(f"stops{_bucket(t.count('.') + t.count(','), (1, 2, 4))}")
        f.append(f"prev{_bucket(long[i - 1] if i else 0, (1, 30, 120))}")
        f.append(f"next{_bucket(long[i + 1] if i + 1 < n else 0, (1, 30, 120))}")
        f.append(f"kin{_bucket(seen[leaf], (2, 4, 8))}")
        if "©" in t:
            f.append("(c)")
        if len(words) < 40:
            f += {f"cue:{CUE_OF[w]}" for w in WORDS.findall(t.lower()) if w in CUE_OF}
        out.append(f)
    return out
