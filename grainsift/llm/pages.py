"""Blocks of a web page and labelled layouts to learn from."""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_WORD = re.compile(r"[a-z]{2,}")

#: elements whose content is no text of the page
_SKIPPED = frozenset("script style template noscript textarea svg math iframe object canvas audio video select title head".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select".split())
#: of these, those that HTML reads as text up to the closing tag, whatever stands between
_RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
#: those that stand inside a run of text without ending it
_PHRASING = _RAW - {"title", "noscript", "template"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr img br".split())
_SECTIONS = frozenset("article main nav aside header footer form section".split())
#: opening one of these ends an open element of the second set
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in _RAW}


def _after(page: str, tag: str, at: int, around: str | None) -> int:
    """Where a page goes on after an element whose content is no text. One that is not raw text ends at the
    latest with the element around it; never closed and inside none, it is its opening tag alone."""
    close = _CLOSE[tag].search(page, at)
    if tag in _RAW_TEXT:
        return close.end() if close else len(page)
    stop = close.start() if close else len(page)
    depth = 0
    for m in re.compile(rf"<(/?){re.escape(around)}\b", re.I).finditer(page, at, stop) if around else ():
        depth += -1 if m[1] else 1
        if depth < 0:
            return m.start()
    return close.end() if close else at


@dataclass
class Block:
    """A run of text between block boundaries."""

    text: str
    path: tuple[str, ...]
    names: frozenset[str]
    linked: int
    tag: str
    box: str


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if kind == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.append("hidden")
        elif kind == "hidden":
            found.append("hidden")
        else:
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            found += _NAME_WORD.findall(value)
    return tuple(found)


def _box(solid: list[tuple[str, tuple[str, ...]]]) -> str:
    """The nearest element around that says what it is, by its tag or by a name."""
    for tag, names in reversed(solid):
        if tag in _SECTIONS:
            return f"{tag} named" if names else tag
        if names:
            return "named"
    return ""


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with the tags and the words of classes and ids around them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                solid = [s for s in stack if s[0] not in _INLINE]
                out.append(Block(text, tuple(s[0] for s in solid), frozenset(n for s in solid for n in s[1]),
                                 min(linked, len(text)), solid[-1][0] if solid else "", _box(solid)))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def pop_to(index: int) -> None:
        nonlocal links
        for name, _ in stack[index:]:
            links -= name == "a"
        del stack[index:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        inline = tag in _INLINE
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in _RAW and not closing:
            if tag in _PHRASING:
                if tag not in ("script", "style"):
                    pieces.append(" ")
            else:
                flush()
            if not (tag in ("svg", "math") and m[2].endswith("/")):
                at = _after(page, tag, at, stack[-1][0] if stack else None)
            continue
        if not inline and not (closing and tag in _PHRASING):
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if inline and stack[i][0] not in _INLINE:
                    break
            continue
        if tag in _VOID or m[2].endswith("/") and tag in _SKIPPED:
            continue
        if tag == "a" and links:
            i = max(i for i, s in enumerate(stack) if s[0] == "a")
            pop_to(i)
        if not inline:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name in _ENDS.get(tag, ()) or name == "p":
                    pop_to(i)
                    if name == "p" and tag not in _ENDS:
                        break
                elif name not in _INLINE and tag not in ("tr",):
                    break
        links += tag == "a"
        stack.append((tag, _names(m[2]) if m[2] else ()))
    flush()
    return out


# ---------------------------------------------------------------- labelled layouts

_MAIN = ["<article>", "<main>", "<main><article>", '<div class="post-content">', '<div class="entry-content">', '<div id="content">',
         '<section class="story-body">', '<div class="article-body">', '<div itemprop="articleBody">', '<div class="text">',
         '<div class="story">', '<div class="blog-post">', '<td class="content">', "<div>", "<section>"]
_MENU = ["<nav>", '<div class="menu">', '<div id="navigation">', '<div class="navbar">', '<div class="breadcrumbs">',
         '<div role="navigation">', '<div class="main-menu">', '<div class="pagination">', '<div class="toc">']
_HEADER = ["<header>", '<div id="header">', '<div class="masthead">', '<div class="topbar">', '<div class="site-header">',
           '<div role="banner">', '<div class="logo">']
_FOOTER = ["<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', '<div role="contentinfo">',
           '<div class="legal">', '<div class="bottom">']
_SIDE = ["<aside>", '<div class="sidebar">', '<div class="widget">', '<div id="right-column">', '<div class="related">',
         '<div class="related-posts">', '<div role="complementary">', '<div class="popular">', '<div class="recommended">',
         '<section class="trending">', '<div class="author-bio">', '<div class="tags">', '<div class="share">', '<div class="social">']
_NOTICE = ['<div class="cookie-notice">', '<div id="cookie-banner">', '<div role="alert">', '<div class="consent">',
           '<div class="notice">', '<div class="gdpr">', '<div class="notification">', '<div class="alert alert-info">',
           '<div class="newsletter">', '<div class="subscribe">', '<div class="paywall">', '<div class="popup">', '<div class="modal">',
           '<div class="disclaimer">', '<div class="overlay">', '<div role="dialog">', '<div class="privacy">']
_AD = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">',
       '<div class="promo">', '<div id="ad-top">', '<div class="ad-slot">', '<aside class="ad">', '<div class="banner-ad">',
       '<section class="promoted">', '<p class="ad">', '<p class="sponsor">']
_FORM = ["<form>", '<form class="search">', '<div class="login"><form>', '<form id="newsletter-form">', '<div class="contact-form"><form>']
_COMMENTS = ['<section id="comments">', '<div class="comments">', '<div class="comment-list">', '<ol class="commentlist">',
             '<div class="comment">', '<div id="discussion">', '<div class="reader-comments">', '<div class="replies">',
             '<div class="responses">', '<ul class="comments-list">', '<div id="disqus_thread">', '<aside class="comments">',
             '<section class="user-comments">', '<div class="feedback">', '<article class="comment">']
_NOTES = ["We use cookies to improve this site.", "Accept all cookies", "Subscribe to our newsletter", "Sign up now",
          "All rights reserved.", "© 2024 Example Inc.", "Read more", "Share this", "Advertisement", "Privacy policy",
          "Terms of use", "Log in", "Leave a comment", "Reply", "Most popular", "Related articles", "Back to top",
          "Diese Seite verwendet Cookies.", "Ce site utilise des cookies.", "Este sitio usa cookies.", "Impressum", "Mentions légales"]


def _closed(opening: str, inner: str) -> str:
    tags = re.findall(r"<([a-z]+)", opening)
    return opening + inner + "".join(f"</{t}>" for t in reversed(tags))


def labelled_layout(paragraphs: list[str], rng: random.Random) -> list[tuple[str, int]]:
    """A page as pieces of markup with label 1 for main text, 0 for the rest, from given paragraphs.

    The words say nothing about the label but for a few notes: menus, notices and comments are made of
    the same paragraphs, so tags, names, links, lengths and neighbours have to tell.
    """
    words = " ".join(paragraphs).split() or ["a"]
    def pick(kinds: list[str]) -> str:
        return kinds[0] if rng.random() < 0.3 else rng.choice(kinds)
    def some(least: int, most: int) -> str:
        at = rng.randrange(len(words))
        return entities.escape(" ".join(words[at:at + rng.randint(least, most)]))
    def note() -> str:
        return entities.escape(rng.choice(_NOTES)) if rng.random() < 0.4 else some(1, 12)
    def menu() -> str:
        items = "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(rng.randint(2, 8)))
        return _closed(pick(_MENU), f"<ul>{items}</ul>")
    def side() -> str:
        inner = rng.choice([f"<h3>{some(1, 4)}</h3><ul><li><a href='/x'>{some(2, 8)}</a></li><li><a href='/y'>{some(2, 8)}</a></li></ul>",
                            f"<p>{some(4, 60)}</p>", f"{some(2, 40)}", f"<h4>{some(1, 4)}</h4><p>{some(5, 50)}</p>"])
        return _closed(pick(_SIDE), inner)
    def boxed(kinds: list[str], most: int) -> str:
        text = some(2, most) if rng.random() < 0.7 else note()
        return _closed(pick(kinds), f"<p>{text}</p>" if rng.random() < 0.5 else text)
    def form() -> str:
        return _closed(pick(_FORM), f"<label>{some(1, 3)}</label><input name='q'><p>{note()}</p><button>{some(1, 2)}</button>")
    def comments() -> str:
        one = lambda: rng.choice([f"<p>{some(3, 80)}</p>", f"<div><b>{some(1, 2)}</b> {some(5, 80)}</div>",
                                  f"<li><p>{some(3, 60)}</p></li>", f"<div class='comment-body'><p>{some(3, 80)}</p></div>"])
        head = f"<h3>{some(1, 3)}</h3>" if rng.random() < 0.5 else ""
        return _closed(pick(_COMMENTS), head + "".join(one() for _ in range(rng.randint(1, 5))))
    def extra() -> str:
        return rng.choice([menu, side, form, comments, lambda: boxed(_NOTICE, 40), lambda: boxed(_AD, 30)])()

    pieces: list[tuple[str, int]] = [(rng.choice(["<body>", "<!DOCTYPE html><html><head><title>x</title></head><body>",
                                                  "<html><body><div>", '<html><body><div id="page">']), 0)]
    for part in (lambda: boxed(_HEADER, 8), menu, lambda: boxed(_NOTICE, 40), lambda: boxed(_AD, 30), side):
        if rng.random() < 0.5:
            pieces.append((part(), 0))
    opening = pick(_MAIN)
    pieces.append((opening, 0))
    if rng.random() < 0.8 and paragraphs:
        level = rng.choice("112")
        pieces.append((f"<h{level}>{entities.escape(paragraphs[0][:rng.randint(20, 80)])}</h{level}>", 1))
    for paragraph in paragraphs:
        shape = rng.random()
        if rng.random() < 0.25:                        # short paragraphs are main text too
            cut = rng.randrange(len(paragraph) + 1)
            paragraph = " ".join(paragraph[cut:].split()[:rng.randint(1, 12)]) or paragraph
        text = entities.escape(paragraph)
        if shape < 0.04:
            lead = some(1, 6)
            pieces.append((f"<h{rng.choice('234')}>{lead}</h{rng.choice('2')}>", 1))
        tag = rng.choices(["p", "div", "li", "blockquote", "pre", "td"], [80, 6, 6, 4, 2, 2])[0]
        pieces.append((f"<{tag}>{'<b>' if shape > 0.95 else ''}{text}" + ("" if tag == "p" and shape < 0.2 else f"</{tag}>"), 1))
        if rng.random() < 0.1:
            pieces.append((extra(), 0))
    pieces.append(("".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening))), 0))
    for part in (comments, side, lambda: boxed(_AD, 30), form, lambda: boxed(_NOTICE, 40), menu, lambda: boxed(_FOOTER, 15)):
        if rng.random() < 0.5:
            pieces.append((part(), 0))
    return pieces


def labelled_blocks(pieces: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled layout, each with the label of the piece it begins in."""
    marks = {0: "", 1: ""}
    page = "".join(re.sub(r">(\s*)([^<\s])", lambda m: f">{m[1]}{marks[label]}{m[2]}", piece) for piece, label in pieces)
    found, labels = [], []
    for block in blocks(page):
        label = 1 if "" in block.text else 0
        text = " ".join(block.text.replace("", "").replace("", "").split())
        if text:
            found.append(Block(text, block.path, block.names, min(block.linked, len(text)), block.tag,
                               block.box))
            labels.append(label)
    return found, labels
