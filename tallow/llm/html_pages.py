"""Labelled pages to train on: made from a seed, in many layouts, with what is main text known."""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go hu in ja ko lu me no or pa re sa ti un ve wo xa ya ze".split()
# How sites name their parts.
MAIN = ["content", "main-content", "post-body", "entry-content", "article-body", "story", "text", "post"]
NAV = ["nav", "menu", "navbar", "breadcrumbs", "navigation", "top-menu", "site-nav"]
HEAD = ["header", "site-header", "masthead", "banner", "top"]
FOOT = ["footer", "site-footer", "bottom", "copyright", "legal"]
SIDE = ["sidebar", "aside", "related", "widget", "trending", "recommended"]
NOTE = ["notice", "cookie-notice", "alert", "consent", "gdpr", "popup", "message"]
ADS = ["ad", "ads", "advert", "sponsored", "promo", "banner-ad"]
TALK = ["comments", "comment-list", "replies", "discussion", "comment"]


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def sentence(self, least: int = 4, most: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(least, most))]
        style = self.rng.random()
        if style < 0.06:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.12:
            words = [w + self.rng.choice(("***", "$$$", "%%%", "###")) for w in words]
        return " ".join(words).capitalize() + self.rng.choice(".....!?")

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def div(self, kinds: list[str], tag: str | None = None) -> str:
        r = self.rng
        if tag and r.random() < 0.55:
            name = f' class="{r.choice(kinds)}"' if r.random() < 0.4 else ""
            return f"<{tag}{name}>|</{tag}>"
        key = r.choice(("class", "class", "id"))
        return f'<div {key}="{r.choice(kinds)}">|</div>'


def page(seed: int) -> list[tuple[str, str | None]]:
    """(markup, text of the block that ends here or None; a leading + marks main text) in page order."""
    rng = random.Random(seed)
    make = _Maker(rng)
    out: list[tuple[str, str | None]] = []

    def put(wrap: str, main: bool, parts: list[str]) -> None:
        """parts: HTML with @ before each block's text."""
        before, after = wrap.split("|")
        out.append((before, None))
        for tag_text in parts:
            if tag_text.startswith("<"):  # around the items of a list
                out.append((tag_text, None))
                continue
            tag, text = tag_text.split("@", 1)
            name = tag.split()[0]
            linked = name == "li" or (not main and rng.random() < 0.3)
            body = f'<a href="/{make.word()}">{text}</a>' if linked and not main else text
            if main and rng.random() < 0.2 and " " in text:
                a, b = text.split(" ", 1)
                body = f"<b>{a}</b> {b}"
            out.append((f"<{tag}>{body}" + ("" if rng.random() < 0.05 and name == "p" else f"</{name}>"), ("+" if main else "-") + text))
        out.append((after, None))

    short = lambda: " ".join(make.word() for _ in range(rng.randint(1, 4)))
    title = make.sentence(3, 10) if rng.random() < 0.5 else short()
    if rng.random() < 0.5:
        put(make.div(HEAD, "header"), False, [f"{rng.choice(('h1', 'p', 'div'))}@{short()}"] + ([f"p@{make.sentence(2, 8)}"] if rng.random() < 0.5 else []))
    if rng.random() < 0.9:
        put(make.div(NAV, "nav").replace("|", "<ul>|</ul>"), False, [f"li@{short() if rng.random() < 0.6 else rng.choice(('Home', 'About', 'Contact', 'Search', 'The', 'and'))}" for _ in range(rng.randint(2, 9))])
    extras = [lambda: put(make.div(ADS), False, [f"{rng.choice(('p', 'div', 'p'))}@{make.sentence(3, 20)}"]),
              lambda: put(make.div(NOTE), False, [f"p@{rng.choice(('We use cookies. ', 'This site asks for your consent. ', 'Notice: ', ''))}{make.sentence(3, 14)}"]),
              lambda: put(make.div(SIDE, "aside"), False, [f"h3@{rng.choice(('Related', 'Popular', 'Read more', short()))}"] + [f"{rng.choice(('li', 'p'))}@{make.sentence(2, 9)}" for _ in range(rng.randint(1, 5))]),
              lambda: put("<form>|</form>", False, [f"label@{rng.choice(('Email', 'Subscribe to our newsletter', 'Search', short()))}", f"button@{rng.choice(('Send', 'Sign up', 'Login'))}"]),
              ]
    bare = lambda: out.append((f'<div class="{rng.choice(ADS + NOTE)}">' + (t := make.sentence(2, 18)) + "</div>", "-" + t))
    for _ in range(rng.randint(0, 2)):
        rng.choice([*extras, bare])()
    paras = [f"{rng.choice(('h1', 'h1', 'h2'))}@{title}"]
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.72:
            paras.append(f"p@{make.prose() if rng.random() < 0.9 else make.sentence(1, 4)}")
        elif kind < 0.82:
            paras.append(f"{rng.choice(('h2', 'h3'))}@{make.sentence(1, 8)}")
        elif kind < 0.9:
            paras.append(f"blockquote@{make.prose(1, 3)}")
        elif kind < 0.92:
            paras += [f"td@{short()}" for _ in range(rng.randint(2, 4))]
        elif kind < 0.95:
            form = rng.random()
            say = lambda: make.sentence(2, 14) if rng.random() < 0.6 else short()
            if form < 0.6:
                tag = rng.choice(("ul", "ul", "ol"))
                paras.append([f"<{tag}>", *[f"li@{say()}" for _ in range(rng.randint(2, 6))], f"</{tag}>"])
            elif form < 0.8:
                paras.append(["<dl>", *[x for _ in range(rng.randint(1, 4)) for x in (f"dt@{short()}", f"dd@{say()}")], "</dl>"])
            else:
                paras.append(["<figure>", f"figcaption@{say()}", "</figure>"])
        else:
            paras += [f"pre@{make.sentence()}"]
    inside = rng.random() < 0.4  # boilerplate within the article
    wrap = make.div(MAIN, rng.choice(("article", "main", "article")))
    cut = rng.randint(1, len(paras))
    before, after = wrap.split("|")
    flat = lambda some: [x for p in some for x in (p if isinstance(p, list) else [p])]
    put(before + "|", True, flat(paras[:cut]))
    if inside:
        rng.choice([*extras, bare])()
    put("|" + after, True, flat(paras[cut:]))
    for _ in range(rng.randint(0, 2)):
        rng.choice([*extras, bare])()
    if rng.random() < 0.4:
        put(make.div(TALK, "section"), False, [f"h3@{rng.choice(('Comments', '3 comments', 'Replies', 'Discussion'))}"] + [f"{rng.choice(('p', 'li', 'div'))}@{make.prose(1, 3)}" for _ in range(rng.randint(1, 5))])
    if rng.random() < 0.9:
        put(make.div(FOOT, "footer"), False, [f"p@© {short()} · {make.sentence(1, 10)}"] if rng.random() < 0.5 else [f"div@{rng.choice(('All rights reserved. ', 'Copyright ', ''))}{make.sentence(1, 10)}"])
    return out


def labelled(count: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(html, texts of the blocks in page order, main ones with a leading +)."""
    pages = []
    for k in range(count):
        parts = page(seed * 1_000_003 + k)
        pages.append(("<html><head><title>t</title></head><body>" + "".join(p for p, _ in parts) + "</body></html>", [t for _, t in parts if t]))
    return pages
