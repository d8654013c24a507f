"""Made-up web pages whose parts are known, to train the extraction model on."""

from __future__ import annotations

import numpy as np

_SYLLABLES = "ba be bi bo ca ce co da de di do fa fi ga ge go ha he hi ho ka ke la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se si so ta te ti to va ve vi wa we".split()


def _word(r: np.random.Generator) -> str:
    return "".join(_SYLLABLES[i] for i in r.integers(0, len(_SYLLABLES), int(r.integers(1, 4))))


def words(r: np.random.Generator, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(int(r.integers(low, high + 1))))


def sentences(r: np.random.Generator, low: int, high: int) -> str:
    out = []
    for _ in range(int(r.integers(low, high + 1))):
        s = words(r, 1, 18)
        out.append(s[0].upper() + s[1:] + ".")
    mark = r.choice(["", "", "", "", "###", "!!"])
    return " ".join(out) if not mark else " ".join(w + mark for w in " ".join(out).split())


def _pick(r: np.random.Generator, *options: str) -> str:
    return str(r.choice(options))


def _attrs(r: np.random.Generator, *options: str) -> str:
    """One of the class or id names, or none."""
    name = _pick(r, *options, "", "x" + _word(r))
    return f' {_pick(r, "class", "id", "class")}="{name}"' if name else ""


def link_list(r: np.random.Generator) -> str:
    items = "".join(f'<li><a href="/{_word(r)}">{words(r, 1, 3)}</a></li>' for _ in range(int(r.integers(2, 10))))
    return f"<ul>{items}</ul>" if r.random() < 0.8 else " | ".join(f'<a href="/{_word(r)}">{words(r, 1, 2)}</a>' for _ in range(int(r.integers(2, 8))))


def in_line(r: np.random.Generator) -> str:
    """An element of a line that isn't of the text, by its class."""
    name = _pick(r, "ad", "ads", "ad-label", "advert", "sponsored", "promo", "share", "social", "share-count", "like", "newsletter", "comment-count", "reply", "notice", "subscribe")
    tag = _pick(r, "span", "span", "small", "em", "b", "a")
    return f'<{tag} data-y="b" {_pick(r, "class", "class", "id")}="{name}">{words(r, 1, 5)}</{tag}>'


def paragraph(r: np.random.Generator) -> str:
    kind = r.random()
    text = sentences(r, 1, 9) if r.random() < 0.85 else words(r, 1, 3).capitalize() + "."
    if r.random() < 0.06:
        text = f"{text} {in_line(r)} {sentences(r, 0, 2)}"
    if r.random() < 0.02:
        return f'<pre><code>{words(r, 2, 12)} <span class="comment">{words(r, 1, 6)}</span> {words(r, 0, 9)}</code></pre>'
    if kind < 0.12:
        return f"<p><b>{text}<br>"
    if kind < 0.2:
        return f"<p>{text}"
    if kind < 0.3:
        return f'<p>{text} <a href="/x">{words(r, 1, 4)}</a> {sentences(r, 1, 2)}</p>'
    if kind < 0.35:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind < 0.4:
        return "<ul>" + "".join(f"<li>{sentences(r, 1, 2)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>"
    if kind < 0.44:
        return "<table>" + "".join(f"<tr><td>{words(r, 1, 3)}</td><td>{words(r, 1, 5)}</td></tr>" for _ in range(int(r.integers(2, 6)))) + "</table>"
    if kind < 0.5:
        return f"<h{r.integers(2, 5)}>{words(r, 1, 8)}</h{r.integers(2, 5)}>" if r.random() < 0.1 else f"<h3>{words(r, 1, 8)}</h3>"
    if kind < 0.53:
        return f"<figure><img src=x><figcaption>{sentences(r, 1, 1)}</figcaption></figure>"
    if kind < 0.56:
        return f"<div>{text}</div>"
    return f"<p>{text}</p>"


def boilerplate(r: np.random.Generator, inside: bool = False) -> str:
    """A part that isn't the article, anywhere, or such as stands inside articles."""
    y = ' data-y="b"'
    kinds = {
        "ad": lambda: f'<{_pick(r, "div", "div", "aside", "section")}{y} class="{_pick(r, "ad", "ads", "advert", "sponsored", "promo", "ad-slot", "adbox", "advertisement")}">{sentences(r, 1, 3)}',
        "share": lambda: f'<div{y} class="{_pick(r, "share", "social-links", "sharing", "follow")}">{link_list(r)}',
        "related": lambda: f'<{_pick(r, "div", "aside", "section")}{y}{_attrs(r, "related", "recommended", "more-stories", "popular")}><h3>{words(r, 1, 3)}</h3>{link_list(r)}',
        "notice": lambda: f'<div{y} class="{_pick(r, "cookie-notice", "notice", "alert", "newsletter", "popup", "consent", "subscribe", "disclaimer")}"><p>{sentences(r, 1, 4)}</p><button>{words(r, 1, 2)}</button>',
        "comments": lambda: f'<{_pick(r, "div", "section", "ol")}{y} {_pick(r, "id", "class")}="{_pick(r, "comments", "comment-list", "discussion", "replies", "respond")}">' + _pick(r, "", f"<h2>{words(r, 1, 2)}</h2>", f"<h3>{words(r, 1, 3)}</h3>") + "".join(f'<{_pick(r, "div", "article", "li")}{_attrs(r, "comment", "reply")}><p>{sentences(r, 1, 4)}</p></div>' for _ in range(int(r.integers(1, 6)))),
        "form": lambda: f'<form{y}{_attrs(r, "search", "login", "contact")}>{words(r, 1, 4)}<input name=q><button>{words(r, 1, 1)}</button><p>{sentences(r, 1, 1)}</p>',
        "byline": lambda: f'<div{y} class="{_pick(r, "meta", "byline", "author", "tags")}">{words(r, 2, 5)} <a href=x>{words(r, 1, 2)}</a>',
        "nav": lambda: f'<{_pick(r, "nav", "nav", "div", "ul", "div")}{y}{_attrs(r, "nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination")}>{link_list(r)}',
        "header": lambda: f'<header{y}{_attrs(r, "header", "masthead", "top")}><a href="/">{words(r, 1, 3)}</a> {words(r, 0, 6)}',
        "head_div": lambda: f'<div{y} {_pick(r, "id", "class")}="{_pick(r, "header", "site-header", "masthead", "banner", "logo")}"><a href="/">{words(r, 1, 3)}</a> {words(r, 0, 6)}',
        "footer": lambda: f'<footer{y}{_attrs(r, "footer", "site-footer")}>&copy; {words(r, 1, 3)} &middot; {sentences(r, 1, 4)}',
        "foot_div": lambda: f'<div{y} {_pick(r, "id", "class")}="{_pick(r, "footer", "copyright", "legal", "site-footer")}"><p>&copy; {words(r, 1, 3)} {sentences(r, 1, 3)}</p>',
        "sidebar": lambda: f'<{_pick(r, "aside", "div")}{y} {_pick(r, "id", "class")}="{_pick(r, "sidebar", "side", "widget-area", "rail", "secondary sidebar")}"><h3>{words(r, 1, 3)}</h3><p>{sentences(r, 1, 4)}</p>{link_list(r) if r.random() < 0.7 else ""}',
        "bare_header": lambda: f'<header{y}><a href="/">{words(r, 1, 4)}</a>',
        "titled_header": lambda: f'<header{y}{_attrs(r, "header", "top")}><{(h := _pick(r, "h1", "h2", "p"))}>{words(r, 1, 4).title()}</{h}>{_pick(r, "", "", f"<p>{words(r, 2, 8)}</p>")}',
        "line": lambda: f'<p{y} class="{_pick(r, "notice", "ad", "copyright", "meta", "share", "cookie", "warning", "sponsored")}">{sentences(r, 1, 2)}',
        "nested": lambda: f'<div{y} {_pick(r, "id", "class")}="{_pick(r, "header", "footer", "sidebar", "comments", "nav", "notice", "ads", "login-form")}"><div{_attrs(r, "inner", "container", "wrap")}><p>{sentences(r, 1, 5)}</p></div><p>{words(r, 1, 6)}</p>',
        "aside": lambda: f"<aside{y}><h4>{words(r, 1, 3)}</h4><p>{sentences(r, 1, 3)}</p>",
    }
    name = _pick(r, *(("ad", "share", "related", "notice", "comments", "byline", "form", "nav", "aside", "line") if inside else tuple(kinds)))
    made = kinds[name]()
    tag = made[1 : made.index(" ")]
    heading = f"<{(h := _pick(r, 'h2', 'h3', 'h4'))}{y}>{words(r, 1, 3)}</{h}>" if name in ("comments", "related") and r.random() < 0.4 else ""
    return f"{heading}{made}</{tag}>"


def make_page(r: np.random.Generator) -> str:
    """A whole page; data-y names the state of a node and of what is below it."""
    tag = _pick(r, "article", "article", "article", "main", "div", "div", "section")
    name = _attrs(r, "content", "post", "entry-content", "article-body", "story", "main", "post-body") if tag == "article" or r.random() < 0.2 else f' {_pick(r, "class", "id")}="{_pick(r, "content", "post", "entry-content", "article-body", "story-text", "main-content", "post-body", "text")}"'
    many = int(r.choice([1, 2, 4, 8, 15, 25]))
    parts = [paragraph(r) for _ in range(many)]
    for _ in range(int(r.choice([0, 0, 0, 1, 2]))):
        parts.insert(int(r.integers(0, len(parts) + 1)), boilerplate(r, inside=True))
    title = f"<h1>{words(r, 1, 12)}</h1>"
    if tag in ("section", "main", "div") and r.random() < 0.25:
        name = f'{_pick(r, "", name)} role="main"'
    lead = _pick(r, title, title, f"<header>{title}</header>", f'<header class="{_pick(r, "entry-header", "post-header", "article-header")}">{title}</header>', "")
    body = f'<{tag}{name} data-y="c">{lead}{"".join(parts)}</{tag}>'
    for _ in range(int(r.choice([0, 0, 1, 2]))):
        body = f'<{_pick(r, "div", "main", "section")}{_attrs(r, "wrapper", "container", "page", "content", "layout")} data-y="m">{"".join(boilerplate(r) for _ in range(int(r.choice([0, 1]))))}{body}{"".join(boilerplate(r) for _ in range(int(r.choice([0, 1, 2]))))}</div>'
    before = "".join(boilerplate(r) for _ in range(int(r.integers(0, 4))))
    after = "".join(boilerplate(r) for _ in range(int(r.integers(0, 4))))
    end = "</body></html>" if r.random() < 0.9 else ""
    if r.random() < 0.04:
        return f'<html><body data-y="c">{"".join(parts)}{before}{end}'
    return f'<!DOCTYPE html><html><head><title>{words(r, 1, 5)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body data-y="m">{before}<!-- x -->{body}{after}{end}'
