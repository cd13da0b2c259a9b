"""Labelled pages for the block classifier: invented text in thirteen layouts, made by rule from a seed.

Class names mislead on purpose: wrappers of whole articles are called after sidebars, comments or menus, and some layouts
call nothing by its name. Each page comes with the texts of the blocks that belong to its main text, in order.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo tra ple str ing ent ion".split()


class Writer:
    """Writes one page; ``kept`` collects the blocks of the main text."""

    def __init__(self, seed: int):
        self.rng, self.kept = random.Random(seed), []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def linked(self, low: int, high: int) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.words(low, high)}</a>'

    def keep(self, text: str) -> str:
        self.kept.append(text)
        return text

    def name(self, *names: str) -> str:
        return f' class="{self.rng.choice(names)}"' if names else ""

    # what surrounds an article

    def menu(self, tag: str = "ul", n: tuple[int, int] = (3, 9)) -> str:
        item = "li" if tag == "ul" else "div"
        return f"<{tag}>" + "".join(f"<{item}>{self.linked(1, 3)}</{item}>" for _ in range(self.rng.randint(*n))) + f"</{tag}>"

    def teasers(self, tag: str = "div") -> str:
        return "".join(f"<{tag}><h3>{self.linked(2, 8)}</h3><p>{self.words(8, 35)}</p><p>{self.linked(2, 3)}</p></{tag}>" for _ in range(self.rng.randint(1, 4)))

    def comments(self, tag: str = "div", names: tuple[str, ...] = ()) -> str:
        def one() -> str:
            texts = "".join(f"<p>{self.words(2, 50)}</p>" for _ in range(self.rng.randint(1, 2)))
            return f"<{tag}{self.name(*names)}><div>{self.linked(1, 2)}</div><div>{self.words(2, 4)}</div>{texts}<div>{self.linked(1, 1)}</div></{tag}>"

        return f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.rng.randint(0, 12)))

    def small_print(self) -> str:
        return f"&copy; {self.words(2, 12)} {self.linked(1, 2)}"

    def form(self) -> str:
        return f"<form action=/f><label>{self.words(2, 15)}</label><input name=q><p>{self.words(0, 12)}</p><button>{self.words(1, 2)}</button></form>"

    # the article

    def paragraph(self) -> str:
        r, kind = self.rng, self.rng.random()
        if kind < 0.1:
            a, b, c = self.words(10, 40), self.words(1, 4), self.words(5, 40)
            self.keep(f"{a} {b} {c}")
            return f"<p>{a} <a href=/x>{b}</a> {c}</p>"
        if kind < 0.2:
            return "<ul>" + "".join(f"<li>{self.keep(self.words(1, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.28:
            return f"<h2>{self.keep(self.words(1, 8))}</h2>"
        if kind < 0.33:
            return f"<blockquote>{self.keep(self.words(5, 40))}</blockquote>"
        if kind < 0.37:
            return f"<pre>{self.keep(self.words(3, 30))}</pre>"
        if kind < 0.41:
            return f'<figure><img src="i.png"><figcaption>{self.keep(self.words(3, 15))}</figcaption></figure>'
        if kind < 0.45:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        if kind < 0.47:
            return f"<p><a href=/y>{self.keep(self.words(1, 12))}</a></p>"
        if kind < 0.6:
            return f"<p>{self.keep(self.words(1, 9))}</p>"
        return f"<p>{self.keep(self.words(12, 110))}</p>"

    def story(self, between: Callable[[], str] = lambda: "", few: int = 1, many: int = 14) -> str:
        out = []
        for _ in range(self.rng.randint(few, many)):
            out.append(self.paragraph())
            if self.rng.random() < 0.12:
                out.append(between())
        return "".join(out)

    def long_story(self) -> str:
        """Of running text alone, where no element names the article."""
        out = []
        for _ in range(self.rng.randint(3, 9)):
            out.append(f"<p>{self.keep(self.words(25, 110))}</p>")
            if self.rng.random() < 0.3:
                out.append(f"<p>{self.keep(self.words(12, 30))}</p>")
        return "".join(out)

    def title(self) -> str:
        return f"<h1>{self.keep(self.words(2, 12))}</h1>"


def plain_article(w: Writer) -> str:
    ad = lambda: f'<div class="ad">{w.words(4, 25)}</div>'
    before = ad() if w.rng.random() < 0.7 else ""
    return f"<body><nav>{w.menu()}</nav>{before}<article>{w.title()}{w.story(ad)}</article>{ad() if w.rng.random() < 0.3 else ''}<footer>{w.small_print()}</footer></body>"


def semantic(w: Writer) -> str:
    aside = lambda: f"<aside>{w.words(5, 30)}{w.linked(1, 4)}</aside>"
    head = f"<header><h1>{w.linked(1, 3)}</h1><p>{w.words(2, 9)}</p><nav>{w.menu()}</nav></header>"
    notes = f"<section{w.name('comments', 'replies')} id=comments>{w.comments('article', ('comment', ''))}</section>"
    return f"<body>{head}<main><article><header>{w.title()}</header>{w.story(aside)}<footer>{w.words(2, 9)}</footer></article>{notes}</main><aside>{w.teasers()}</aside><footer>{w.menu()}<p>{w.small_print()}</p></footer></body>"


def main_only(w: Writer) -> str:
    return f"<body><div role=banner><div>{w.linked(1, 3)}</div>{w.menu('div')}</div><main id=m>{w.title()}{w.story(w.form)}</main><div{w.name('sidebar', 'widgets')}>{w.teasers()}{w.form()}</div><div{w.name('footer', 'site-info')}>{w.small_print()}</div></body>"


def named_divs(w: Writer) -> str:
    part = lambda: f"<div{w.name('ad', 'advert', 'promo', 'related', 'share', 'newsletter')}><p>{w.words(4, 30)}</p></div>"
    menu = f"<div{w.name('menu', 'navbar', 'top-nav')}>{w.menu()}</div><div id=cookie-notice><p>{w.words(12, 40)}</p></div>"
    notes = f"<div{w.name('comments', 'comment-list')}>{w.comments('div', ('comment',))}</div>" if w.rng.random() < 0.6 else ""
    return f"<body>{menu}<div{w.name('content', 'post', 'entry', 'story')}>{w.title()}{w.story(part, 3)}</div>{notes}<div{w.name('sidebar', 'widget-area')}>{w.teasers()}</div><div id=footer>{w.small_print()}</div></body>"


def nameless_divs(w: Writer) -> str:
    k = [f' class="c{w.rng.randrange(99)}"' for _ in range(5)]
    return f"<body><div{k[0]}>{w.menu('div')}</div><div{k[1]}>{w.title()}{w.long_story()}</div><div{k[2]}>{w.menu()}</div><div{k[4]}>{w.small_print()}</div></body>"


def table_layout(w: Writer) -> str:
    return f"<body><table><tr><td colspan=2><a href=/>{w.words(1, 3)}</a></td></tr><tr><td>{w.menu('div')}</td><td>{w.title()}{w.long_story()}</td></tr><tr><td colspan=2><font size=1>{w.small_print()}</font></td></tr></table></body>"


def form_around(w: Writer) -> str:
    menu = f"<div id=nav>{w.menu()}</div>"
    inner = f"<article>{w.title()}{w.story()}</article>" if w.rng.random() < 0.5 else f"<div id=main>{w.title()}{w.story(few=3)}</div>"
    return f'<body><form id="aspnetForm" method=post><input type=hidden>{menu}{inner}<div class="footer">{w.small_print()}</div></form></body>'


def misnamed_wrappers(w: Writer) -> str:
    body = w.name("right-sidebar single-post", "no-sidebar", "has-sidebar menu-open", "with-comments", "modal-open page")
    wrap = w.name("content-with-sidebar", "wrapper has-menu", "sidebar-layout", "header-fixed container")
    post = w.name("post has-comments", "hentry share-enabled", "entry no-ad", "related-post")
    side = f"<div{w.name('sidebar', 'c7')}>{w.teasers()}</div>" if w.rng.random() < 0.5 else f"<aside>{w.teasers()}</aside>"
    inner = f"<article{post}>{w.title()}{w.story()}</article>" if w.rng.random() < 0.7 else f"<div{post}>{w.title()}{w.story(few=4)}</div>"
    return f"<body{body}><nav>{w.menu()}</nav><div{wrap}>{side if w.rng.random() < 0.5 else ''}{inner}</div><footer>{w.small_print()}</footer></body>"


def article_lists(w: Writer) -> str:
    """Teasers and comments are articles too."""
    near = f"<section{w.name('related', 'more')}><h2>{w.words(1, 3)}</h2>{w.teasers('article')}</section>"
    notes = f"<div id=comments{w.name('comments-area')}>{w.comments('article', ('comment', 'comment reply'))}</div>"
    return f"<body><header><div>{w.linked(1, 3)}</div>{w.menu()}</header><article{w.name('post', 'type-post')}>{w.title()}{w.story()}</article>{notes if w.rng.random() < 0.6 else ''}<aside>{near}</aside><footer>{w.small_print()}</footer></body>"


def unclosed(w: Writer) -> str:
    paragraphs = "".join(f"<p>{w.keep(w.words(1, 60))}" for _ in range(w.rng.randint(2, 9)))
    title = w.keep(w.words(2, 9))
    w.kept.insert(0, w.kept.pop())
    return f"<body><div><ul><li>{w.linked(1, 2)}<li>{w.linked(1, 2)}</ul></div><article><h1>{title}</h1>{paragraphs}</article><hr><div>{w.small_print()}"


def long_discussion(w: Writer) -> str:
    notes = "".join(w.comments("li", ("comment", "comment even")) for _ in range(3))
    return f"<body><div class=top>{w.menu('div')}</div><div{w.name('post', 'body')}>{w.title()}{w.story(few=2, many=5)}</div><div id=comments><ol>{notes}</ol></div>{w.form()}<div>{w.small_print()}</div></body>"


def breaks_only(w: Writer) -> str:
    """One block of running text, parted by line breaks."""
    parts = [w.words(20, 70) for _ in range(w.rng.randint(2, 6))]
    title = w.title()
    w.keep(" ".join(parts))
    return f"<body><center>{' | '.join(w.linked(1, 2) for _ in range(5))}</center>{title}<div>{'<br><br>'.join(parts)}</div><center>{w.small_print()}</center></body>"


def flat(w: Writer) -> str:
    """Nothing is named, enclosed or titled: links and paragraphs side by side."""
    tag = w.rng.choice(("div", "p"))
    links = lambda n: "".join(f"<{tag}>{w.linked(1, 4)}</{tag}>" for _ in range(w.rng.randint(1, n)))
    story = "".join(f"<{tag}>{w.keep(w.words(22, 110))}</{tag}>" for _ in range(w.rng.randint(1, 7)))
    last = f"<{tag}>{w.small_print()}</{tag}>" if w.rng.random() < 0.5 else ""
    return f"<body>{links(8)}{story}{links(5)}{last}</body>"


LAYOUTS = (plain_article, semantic, main_only, named_divs, nameless_divs, table_layout, form_around, misnamed_wrappers, article_lists, unclosed, long_discussion, breaks_only, flat)


def labelled_pages(seed: int, each: int, layouts=LAYOUTS) -> Iterator[tuple[str, str, list[str]]]:
    """(layout, html, texts of the main blocks) of ``each`` pages of every layout."""
    for k, layout in enumerate(layouts):
        for i in range(each):
            w = Writer(seed * 1_000_003 + k * 1009 + i)
            body = layout(w)
            yield layout.__name__, f"<!doctype html><html><head><title>{w.words(2, 6)}</title><style>p{{}}</style></head>{body}</html>", w.kept
