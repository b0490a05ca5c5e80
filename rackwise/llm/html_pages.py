"""Labelled pages to train the extractor on: layouts drawn from a small grammar, each part known to be content or not.

A part's outermost tag carries data-l="c" (content) or "b" (boilerplate); unmarked ancestors are the page's skeleton."""

from __future__ import annotations

import random

WORDS = "a the of and in to we they old new river town people water house small large many year time light story field north market road early late winter garden paper stone letter bridge".split()


def _text(r: random.Random, low: int, high: int, stop: str = ".") -> str:
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + stop


def _links(r: random.Random, n: int) -> str:
    items = "".join(f'<li><a href="/{i}">{_text(r, 1, 3, "")}</a></li>' for i in range(n))
    return f"<ul>{items}</ul>"


def _boilerplate(r: random.Random) -> str:
    """One part around the article; parts that pages name by tag, by class or by id."""
    short, some = _text(r, 2, 8, r.choice((".", "", "!"))), _text(r, 4, 20)
    name = r.choice(("class", "id"))
    return r.choice(
        (
            f'<nav data-l="b">{_links(r, r.randint(3, 9))}</nav>',
            f'<div data-l="b" {name}="{r.choice(("menu", "navbar", "nav-main", "breadcrumb", "sidebar", "related", "share", "social"))}">{_links(r, r.randint(3, 9))}</div>',
            f'<header data-l="b"><a href="/">{short}</a><p>{short}</p></header>',
            f'<footer data-l="b">&copy; {short} {some}</footer>',
            f'<footer data-l="b"><p>{some}</p>{_links(r, 3)}</footer>',
            f'<aside data-l="b"><h3>{short}</h3><p>{some}</p>{_links(r, 4)}</aside>',
            f'<div data-l="b" {name}="{r.choice(("ad", "ads", "advert", "ad-box", "sponsored", "banner", "promo"))}">{r.choice((some, f"<p>{some}</p>"))}</div>',
            f'<div data-l="b" {name}="{r.choice(("cookie-notice", "cookie", "consent", "notice", "popup", "newsletter", "modal"))}"><p>{some}</p><button>{short}</button></div>',
            f'<form data-l="b"><label>{short}</label><p>{some}</p><button>{short}</button></form>',
            f'<div data-l="b" {name}="{r.choice(("comments", "comment-list", "replies"))}">' + "".join(f'<div class="comment"><b>{short}</b><p>{_text(r, 5, 40)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>",
            f'<section data-l="b" {name}="comments"><h2>{short}</h2><p>{_text(r, 5, 40)}</p><p>{_text(r, 5, 40)}</p></section>',
            f'<p data-l="b" {name}="{r.choice(("ad", "copyright", "share", "notice"))}">{some}</p>',
        )
    )


def _article(r: random.Random) -> str:
    parts = [r.choice((f"<h1>{_text(r, 3, 9, '')}</h1>", ""))]
    for _ in range(r.randint(1, 9)):
        parts.append(r.choice([f"<p>{_text(r, 1, 120)}</p>"] * 8 + [f"<h2>{_text(r, 2, 6, '')}</h2>", f"<blockquote>{_text(r, 8, 30)}</blockquote>", f"<ul><li>{_text(r, 2, 12)}</li><li>{_text(r, 2, 12)}</li></ul>", f"<pre>{_text(r, 4, 20, '')}</pre>", f"<table><tr><td>{_text(r, 1, 3, '')}</td><td>{_text(r, 1, 3, '')}</td></tr></table>", f"<div>{_text(r, 10, 60)}</div>", f'<p>{_text(r, 1, 3, "")} <a href="/more">{_text(r, 2, 12, "")}</a>{r.choice(("", ".", " " + _text(r, 1, 3)))}</p>', _boilerplate(r)]))
    body = "".join(parts)
    name = r.choice(("class", "id"))
    return r.choice([f'<article data-l="c">{body}</article>'] * 3 + [f'<main data-l="c">{body}</main>', f'<div data-l="c" {name}="{r.choice(("content", "article", "post", "entry-content", "story", "main", "post-body", "text"))}">{body}</div>', f'<main><article data-l="c">{body}</article></main>', f'<section data-l="c" {name}="article-body">{body}</section>'])


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        before = "".join(_boilerplate(r) for _ in range(r.randint(0, 4)))
        after = "".join(_boilerplate(r) for _ in range(r.randint(0, 4)))
        inside = before + _article(r) + after
        pages.append(f"<html><head><title>x</title></head><body>{r.choice((inside, f'<div>{inside}</div>', f'<div class=\"page wrapper\">{inside}</div>', f'{before}<div id=\"container\">{_article(r)}{after}</div>'))}</body></html>")
    return pages
