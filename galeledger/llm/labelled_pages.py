"""Labelled pages that the extraction model learns from.

Pages are built from parts whose label is known: what belongs to the article and what
stands around it, in five kinds of markup, from a fixed seed. Blocks of the main text
begin with :data:`MARK`.
"""

from __future__ import annotations

import random

from galeledger.llm.html_blocks import NAMES

#: A private-use character that labels a block as main text; it isn't part of the text.
MARK = "\ue000"
PAGES = 600
SEED = 31

_SYLLABLES = "an be con da en fi ga ho is ju ka lo men na or pra qui re son ta un ver wi zu é ñ ü ß".split()


class _Writer:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rnd.choice(_SYLLABLES) for _ in range(self.rnd.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rnd.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 16) -> str:
        return self.words(low, high).capitalize() + self.rnd.choice("....?!:")

    def some(self, share: float) -> bool:
        return self.rnd.random() < share

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    # -- what belongs to the article --

    def paragraph(self) -> str:
        n = self.rnd.choice([1, 1, 1, 2, 3, 5, 8])
        parts = [self.sentence() for _ in range(n)]
        if self.some(0.12):
            parts.append(self.link(self.words(1, 4)))
        if self.some(0.08):
            parts.append(self.rnd.choice(["cookies", "comments", "share", "advertising", "© 2020", "privacy"]))
        text = " ".join(parts)
        if self.some(0.12):
            text = text.rstrip(".?!:")
        if self.some(0.1):
            text = " | ".join(text.split(" "))
        if self.some(0.04):
            text = self.link(self.sentence())
        return f"<b>{text}</b>" if self.some(0.1) else text

    def article(self, semantic: bool) -> str:
        out = []
        heading = f"<h1>{MARK}{self.words(1, 12)}{self.rnd.choice(['', '', '.'])}</h1>"
        if semantic and self.some(0.3):
            heading = f"<header>{heading}<p>{MARK}{self.words(2, 9)}</p></header>"
        if self.some(0.9):
            out.append(heading)
        for _ in range(self.rnd.randint(1, 9)):
            kind = self.rnd.random()
            if kind < 0.68:
                out.append(f"<p>{MARK}{self.paragraph()}" + ("</p>" if self.some(0.8) else ""))
            elif kind < 0.76:
                out.append(f"<{self.rnd.choice(['h2', 'h3'])}>{MARK}{self.words(1, 8)}</h2>")
            elif kind < 0.84:
                name = self.rnd.choice(["ul", "ol"])
                items = "".join(f"<li>{MARK}{self.paragraph()}</li>" for _ in range(self.rnd.randint(1, 5)))
                out.append(f"<{name}>{items}</{name}>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{MARK}{self.paragraph()}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            elif kind < 0.94:
                cells = "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(3))
                out.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.96:
                out.append(f"<pre>{MARK}{self.words(2, 20)}</pre>")
            else:
                out.append(f"<section><h2>{MARK}{self.words(1, 5)}</h2><p>{MARK}{self.paragraph()}</p></section>")
        # Something foreign in the middle or at the end of the article.
        for share, make in (
            (0.25, self.advert), (0.15, self.related), (0.1, self.share), (0.1, self.form), (0.12, self.notice),
        ):
            if self.some(share):
                out.insert(self.rnd.randint(1, len(out)), make(semantic))
        if semantic and self.some(0.2):
            out.append(f"<footer><p>{self.words(2, 8)}</p></footer>")
        return "".join(out)

    # -- what stands around it --

    def boxed(self, inside: str, names: tuple[str, ...], tag: str | None) -> str:
        """A container, by its element or by a class, id or role."""
        if tag and self.some(0.5):
            more = f' class="{self.rnd.choice(names)}"' if self.some(0.3) else ""
            return f"<{tag}{more}>{inside}</{tag}>"
        key = self.rnd.choice(["class", "class", "class", "id", "role"])
        name = self.rnd.choice(names)
        if self.some(0.2):
            name += self.rnd.choice([" wide", " box", "-wrapper", "-1", "_inner", " clearfix"])
        element = self.rnd.choice(["div", "div", "div", "section", "ul" if inside.startswith("<li") else "div"])
        return f'<{element} {key}="{name}">{inside}</{element}>'

    def links(self) -> str:
        n = self.rnd.randint(2, 8)
        items = "".join(f"<li>{self.link(self.words(1, 3))}</li>" for _ in range(n))
        return f"<ul>{items}</ul>" if self.some(0.8) else " | ".join(self.link(self.words(1, 2)) for _ in range(n))

    def menu(self, semantic: bool) -> str:
        return self.boxed(self.links(), NAMES["menu"], "nav" if semantic else None)

    def header(self, semantic: bool) -> str:
        inside = f"<{self.rnd.choice(['h1', 'h2', 'div', 'p'])}>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>"
        return self.boxed(inside + (self.links() if self.some(0.4) else ""), NAMES["header"], "header" if semantic else None)

    def footer(self, semantic: bool) -> str:
        inside = self.rnd.choice([
            f"&copy; {self.word()}.example &middot; {self.sentence()}\n{self.sentence()}",
            f"<p>Copyright © 2024 {self.words(1, 4)}. All rights reserved.</p>{self.links()}",
            f"<p>{self.words(3, 20)}</p><p>{self.link('Privacy policy')} {self.link('Contact')}</p>",
        ])
        return self.boxed(inside, NAMES["footer"], "footer" if semantic else None)

    def related(self, semantic: bool) -> str:
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.links()
        if self.some(0.4):
            inside += f"<p>{self.paragraph()}</p>"
        return self.boxed(inside, NAMES["sidebar"], "aside" if semantic else None)

    def notice(self, semantic: bool) -> str:
        said = self.rnd.choice(["", "This site uses cookies. ", "We value your privacy. "])
        inside = f"<p>{said}{self.sentence(5, 20)}</p><button>{self.word()}</button>"
        return self.boxed(inside if self.some(0.6) else said + self.sentence(5, 20), NAMES["notice"], "dialog" if semantic else None)

    def advert(self, semantic: bool) -> str:
        inside = self.rnd.choice([self.sentence(3, 20), f"<p>{self.sentence(3, 20)}</p>", self.link(self.words(2, 9)), "Advertisement"])
        return self.boxed(inside, NAMES["advert"], "aside" if semantic and self.some(0.2) else None)

    def form(self, semantic: bool) -> str:
        inside = (
            f"<h4>{self.words(1, 4)}</h4><p>{self.sentence(4, 12)}</p><label>{self.word()}</label><input name=q>"
            f"<select><option>{self.word()}<option>{self.word()}</select><textarea>{self.word()}</textarea><button>{self.word()}</button>"
        )
        return f"<form>{inside}</form>" if self.some(0.6) else self.boxed(inside, NAMES["form"], "form")

    def share(self, semantic: bool) -> str:
        return self.boxed("".join(f"<li>{self.link(self.word())}</li>" for _ in range(3)), NAMES["share"], None)

    def comments(self, semantic: bool) -> str:
        one = self.rnd.choice(["div", "li", "article" if semantic else "div"])
        name = self.rnd.choice(NAMES["comments"])
        each = "".join(
            f'<{one} class="{name}"><h4>{self.words(1, 2)}</h4>'
            + "".join(f"<p>{self.paragraph()}</p>" for _ in range(self.rnd.randint(1, 3)))
            + f"</{one}>"
            for _ in range(self.rnd.randint(1, 4))
        )
        title = f"<h3>{self.rnd.choice(['Comments', self.words(1, 3)])}</h3>"
        return self.boxed(title + each + (self.form(semantic) if self.some(0.4) else ""), NAMES["comments"], None)

    def hidden(self, semantic: bool) -> str:
        return self.rnd.choice([
            f"<noscript>{self.sentence()}</noscript>",
            f"<template><p>{self.sentence()}</p></template>",
            f'<div style="display:none">{self.sentence()}</div>',
            f"<div hidden><p>{self.sentence()}</p></div>",
            f"<svg><text>{self.words(1, 4)}</text></svg>",
        ])

    def page(self) -> str:
        kind = self.rnd.choice(["semantic", "semantic", "names", "names", "names", "plain", "plain"])
        semantic = kind == "semantic"
        if kind == "plain":
            # No names at all: only the text and its elements speak.
            tag = self.rnd.choice(["p", "p", "p", "div", "td"])
            body = [
                f"<{tag}>{MARK}{self.sentence(4, 30)} {self.sentence(4, 30)}</{tag}>"
                for _ in range(self.rnd.randint(1, 8))
            ]
            if tag == "td":
                body = [f"<table><tr>{''.join(body)}</tr></table>"]
            if self.some(0.5):
                body.insert(0, f"<h1>{MARK}{self.words(1, 9)}</h1>")
            if self.some(0.5):
                body.insert(0, f"<p>{self.links()}</p>" if self.some(0.5) else self.links())
            if self.some(0.6):
                body.append(f"<hr><p>© {self.words(1, 4)}</p>" if self.some(0.6) else self.links())
            inside = "".join(body)
        else:
            article = self.article(semantic)
            if semantic:
                wrap = self.rnd.choice(["article", "article", "article", "main", "main"])
                article = f"<{wrap}>{article}</{wrap}>"
                if self.some(0.3):
                    article = f"<main>{article}</main>" if wrap == "article" else article
            else:
                # Layout words say what stands beside an article, not what it is.
                beside = self.rnd.choice(["", "", "", "", " has-sidebar", " with-sidebar", " no-sidebar", " no-comments"])
                name = self.rnd.choice(NAMES["main"]) + beside
                article = f'<div {self.rnd.choice(["class", "id"])}="{name}">{article}</div>'
            before = [p(semantic) for p in (self.header, self.menu, self.notice, self.advert, self.form, self.hidden) if self.some(0.45)]
            after = [p(semantic) for p in (self.share, self.related, self.comments, self.advert, self.form, self.related) if self.some(0.4)]
            self.rnd.shuffle(before)
            self.rnd.shuffle(after)
            inside = "".join(before) + article + "".join(after)
            if self.some(0.3):
                inside = f'<div class="{self.rnd.choice(["wrapper", "container", "page", "site", "row"])}">{inside}</div>'
            inside += self.footer(semantic) if self.some(0.85) else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{inside}</body></html>"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages whose blocks of main text begin with :data:`MARK`."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(pages)]
