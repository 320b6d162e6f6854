"""The small labelled table of the block classifier: pages of many layouts, main text marked.

The pages are written by rule from a fixed seed: LAYOUTS are ways to build a page from
parts, in each of which `data-main` marks the elements whose text is main. Adverts,
notices, comments and bylines carry no class names or other hints, so what tells them
from the article is what a block and its neighbours look like.
"""

from __future__ import annotations

from collections.abc import Callable
from random import Random

SEED = 20
PAGES_A_LAYOUT = 14
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo xu ya ze ki do nu".split()


class Writer:
    """Parts of pages, drawn at random."""

    def __init__(self, rng: Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n)).capitalize() + "."

    def some(self, low: int, high: int, part: Callable[[], str]) -> str:
        return "".join(part() for _ in range(self.rng.randint(low, high)))

    def link(self, low: int = 1, high: int = 4) -> str:
        return f"<a href=x>{self.words(low, high)}</a>"

    # what is main

    def length(self) -> tuple[int, int]:
        """Bounds of a paragraph's words: mostly long, now and then very short."""
        return self.rng.choice([(25, 90), (25, 90), (40, 160), (10, 30), (4, 12), (1, 3)])

    def paragraph(self) -> str:
        inner = self.words(*self.length())
        if self.rng.random() < 0.15:
            inner += f" {self.link(1, 2)} {self.words(8, 30)}"
        if self.rng.random() < 0.1:
            inner = f"<b>{inner}<br>"
        return f"<p data-main>{inner}</p>"

    def heading(self, level: int = 2) -> str:
        return f"<h{level} data-main>{self.words(1, 12)}</h{level}>"

    def listing(self) -> str:
        return "<ul data-main>" + self.some(2, 5, lambda: f"<li>{self.words(2, 14)}</li>") + "</ul>"

    def quote(self) -> str:
        return f"<blockquote data-main>{self.words(5, 30)}</blockquote>"

    def body(self) -> str:
        """Paragraphs, with headings, lists, quotes and unmarked adverts between them."""
        out = [self.some(1, 3, self.paragraph)]
        for _ in range(self.rng.randint(0, 4)):
            out.append(self.rng.choice([self.heading, self.heading, self.listing, self.quote, self.advert, self.paragraph])())
            out.append(self.some(1, 4, self.paragraph))
        return "".join(out)

    def brief(self) -> str:
        """An article of a heading and a few paragraphs, all of which may be short."""
        return self.heading(1) + self.some(1, 3, lambda: f"<p data-main>{self.words(*self.rng.choice([(1, 3), (1, 12), (5, 40)]))}</p>")

    def plain_body(self) -> str:
        """An article of bare divisions: only length and neighbours speak for them."""
        block = lambda: f"<div data-main>{self.words(*self.rng.choice([(30, 90), (40, 160), (18, 50)]))}</div>"
        out = [self.heading(1), self.some(2, 4, block)]
        for _ in range(self.rng.randint(0, 3)):
            out.append(self.rng.choice([self.heading, self.advert, block])())
            out.append(self.some(2, 4, block))
        return "".join(out)

    # what is not

    def menu(self) -> str:
        items = [self.link(1, 3) for _ in range(self.rng.randint(2, 9))]
        return self.rng.choice([
            "<nav><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul></nav>",
            "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>",
            "<div>" + " ".join(items) + "</div>",
            "<div>" + "".join(f"<div>{x}</div>" for x in items) + "</div>",
            "<table><tr>" + "".join(f"<td>{x}</td>" for x in items) + "</tr></table>",
            "<p>" + " | ".join(items) + "</p>",
        ])

    def advert(self) -> str:
        text = self.words(*self.rng.choice([(1, 4), (5, 16)]))
        return self.rng.choice([f"<div>{text}</div>", f"<div>{text}</div>", f"<div>{text} {self.link(1, 3)}</div>", f"<p><a href=x>{text}</a></p>"])

    def notice(self) -> str:
        return f"<div>{self.words(6, 20)} <button>{self.words(1, 2)}</button></div>"

    def title(self) -> str:
        return self.rng.choice([
            f"<header><p>{self.words(2, 12)}</p></header>",
            f"<header>{self.link(1, 3)}<p>{self.words(3, 30)}</p></header>",
            f"<div>{self.words(1, 5)}</div>",
            f"<div>{self.link(1, 3)}</div>",
            "",
        ])

    def byline(self) -> str:
        return f"<div>{self.words(2, 6)}</div>"

    def share(self) -> str:
        return "<div>" + " ".join(self.link(1, 1) for _ in range(3)) + "</div>"

    def aside(self) -> str:
        return f"<aside><h3>{self.words(1, 4)}</h3><p>{self.words(5, 70)}</p>{self.some(0, 3, lambda: f'<p>{self.link(3, 9)}</p>')}</aside>"

    def form(self) -> str:
        return f"<form><p>{self.words(4, 30)}</p><label>{self.words(1, 2)}</label><input><button>{self.words(1, 1)}</button></form>"

    def related(self) -> str:
        head = f"<h3>{self.words(1, 3)}</h3>"
        return head + "<ul>" + self.some(2, 6, lambda: f"<li>{self.link(2, 9)}</li>") + "</ul>"

    def comments(self) -> str:
        by = lambda: f"<div>{self.words(1, 4)}</div>"
        text = lambda: self.words(*self.rng.choice([(1, 6), (4, 20), (10, 35)]))
        head = self.rng.choice([f"<h3>{self.words(1, 3)}</h3>", f"<div>{self.words(1, 3)}</div>"])
        one = self.rng.choice([
            lambda: f"{by()}<p>{text()}</p>",
            lambda: f"{by()}<div>{text()}</div><div>{self.link(1, 1)}</div>",
            lambda: f"<div>{self.link(1, 2)}</div><p>{text()}</p>",
        ])
        return f"<div>{head}{self.some(2, 6, one)}</div>"

    def replies(self) -> str:
        return "<section>" + self.some(1, 5, lambda: f"<article><p>{self.words(3, 60)}</p></article>") + "</section>"

    def footer(self) -> str:
        return self.rng.choice([
            f"<footer>{self.words(3, 40)}</footer>",
            f"<footer><p>{self.words(3, 20)}</p><ul><li>{self.link()}</li><li>{self.link()}</li></ul></footer>",
            f"<div>{self.words(3, 12)}</div>",
            f"<div>{self.link()} {self.link()} {self.words(2, 6)}</div>",
            "",
        ])

    def maybe(self, share: float, part: Callable[[], str]) -> str:
        return part() if self.rng.random() < share else ""


def _page(w: Writer, body: str) -> str:
    return f"<html><head><title>{w.words(2, 12)}</title><style>p{{}}</style></head><body>{body}</body></html>"


LAYOUTS: dict[str, Callable[[Writer], str]] = {
    "paper": lambda w: w.title() + w.menu() + w.maybe(0.8, w.advert) + f"<article>{w.heading(1)}{w.body()}</article>" + w.maybe(0.5, w.advert) + w.footer(),
    "paper of adverts": lambda w: w.menu() + w.advert() + f"<article>{w.heading(1)}{w.some(2, 6, lambda: w.paragraph() + w.advert())}</article>" + w.footer(),
    "short news": lambda w: w.title() + w.menu() + w.maybe(0.8, w.advert) + f"<article>{w.brief()}</article>" + w.maybe(0.3, w.aside) + w.footer(),
    "short items": lambda w: w.menu() + w.some(1, 4, w.brief) + w.form() + w.footer(),
    "paper with replies": lambda w: w.menu() + f"<article>{w.heading(1)}{w.byline()}{w.body()}{w.replies()}</article>" + w.aside() + w.footer(),
    "weblog": lambda w: w.title() + w.menu() + f"<div>{w.heading(1)}{w.byline()}{w.body()}{w.share()}</div>" + w.comments() + w.footer(),
    "weblog without byline": lambda w: w.menu() + f"<div>{w.heading(1)}{w.body()}</div>" + w.related() + w.comments() + w.footer(),
    "magazine": lambda w: w.notice() + w.title() + w.menu() + f"<main>{w.heading(1)}{w.body()}{w.aside()}{w.body()}</main>" + w.related() + w.form() + w.footer(),
    "bare divisions": lambda w: w.title() + w.menu() + w.maybe(0.5, w.advert) + w.plain_body() + w.maybe(0.5, w.related) + w.footer(),
    "bare divisions with comments": lambda w: w.menu() + w.plain_body() + w.comments() + w.footer(),
    "old table page": lambda w: w.menu() + f"<table><tr><td>{w.heading(1)}{w.body()}</td></tr></table>" + w.menu(),
    "plain": lambda w: w.heading(1) + w.body() + w.maybe(0.5, w.menu),
    "shop front": lambda w: w.title() + w.menu() + w.some(2, 5, w.advert) + w.related() + w.form() + w.footer(),
    "notes": lambda w: w.title() + w.notice() + w.menu() + f"<section>{w.heading(1)}{w.body()}{w.heading()}{w.body()}</section>" + w.share() + w.footer(),
    "long sides": lambda w: w.menu() + w.aside() + f"<header><p>{w.words(30, 80)}</p></header>" + f"<div>{w.heading(1)}{w.body()}</div>" + w.aside()
    + f"<footer><p>{w.words(30, 80)}</p></footer>",
}


def pages() -> list[tuple[str, str]]:
    """(layout, page) of the whole table."""
    rng = Random(SEED)
    return [(name, _page(w, build(w))) for name, build in LAYOUTS.items() for w in (Writer(rng),) for _ in range(PAGES_A_LAYOUT)]
