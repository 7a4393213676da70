"""Labelled pages from which the weights of HTML extraction are learned.

Blocks that belong to the main text carry the attribute ``x``; everything else is something around it. Some pages are
written by hand, the others are drawn from the usual parts of a page: the parts' elements and names are common ones,
and which of them meet in one page is left to a fixed stream of random numbers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

PAGES = (
    """<html><head><title>Storm closes harbour</title></head><body><header class="site-header"><a href="/">The Coast Times</a><p>News since 1921</p></header>
<nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav><div class="ad">Buy new boots today at half price</div>
<article><h1 x>Storm closes the harbour for two days</h1><p x>The harbour was closed on Monday after a strong storm moved in from the west and damaged several boats.</p>
<p x>Officials said that they expect <a href="/r">repairs</a> to take until the end of the week, and that no one was hurt.</p><h2 x>Ferries cancelled</h2>
<p x>All ferries were cancelled and passengers were asked to call before they travel.</p><ul><li x>Route one is closed until Friday morning.</li><li x>Route two runs every other hour.</li></ul></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Five walks for the autumn</a></li><li><a href="/2">How to bake rye bread</a></li></ul></aside>
<div class="comments"><h3>Comments</h3><p>I was there and the waves were huge, I have never seen anything like it.</p><p>Same here, we had to leave the boat.</p></div>
<footer>&copy; The Coast Times &middot; All rights reserved</footer></body></html>""",
    """<html><body><div id="cookie-notice">We use cookies to improve the site. <button>Accept</button></div><div class="menu"><a href="/">Home</a> <a href="/about">About</a> <a href="/contact">Contact</a></div>
<div class="content"><h1 x>How to prune an apple tree</h1><p x>Prune in late winter, while the tree is asleep, and begin with dead or crossing branches.</p><p x>Cut just above a bud that faces outwards. Keep the middle of the tree open to the light.</p>
<blockquote x>A pigeon should be able to fly through the tree.</blockquote><p x>Stop before you have taken a quarter of the wood.</p></div>
<form action="/subscribe" class="newsletter"><p>Subscribe to our weekly letter</p><input name="e"><button>Sign up</button></form><div class="footer"><p>Garden notes, privacy, terms of use</p></div></body></html>""",
    """<html><body><nav><a href="/a">alpha</a><a href="/b">beta</a></nav><main><h1 x>Annual report of the library</h1><p x>The library lent more books than in any year before.</p><table><tr><td x>Books lent</td><td x>120 thousand</td></tr><tr><td x>Visitors</td><td x>80 thousand</td></tr></table>
<p x>New rooms for reading and for music opened in spring.</p><div class="share-buttons"><a href="/f">Share</a><a href="/t">Post</a></div><figure><img src="r.png"><figcaption x>The new reading room seen from the garden.</figcaption></figure></main>
<aside><p>Opening hours: nine to five</p></aside><footer><p>City library, main square, contact us by mail</p></footer></body></html>""",
    """<html><body><div class="top-banner"><p>Sale ends on Sunday, order now and save</p></div><div class="nav-bar"><ul><li><a href="/1">Shop</a></li><li><a href="/2">Help</a></li></ul></div>
<div class="post"><h2 x>Notes from the workshop</h2><p x>This week I rebuilt the old lathe, which had been standing in the barn for years.</p><p x>The bearings were worn and I had to order new ones, so everything took longer than planned.</p><pre x>speed = 400</pre>
<p x>Next week I will turn the first bowl. <b>Wish me luck.</b></p></div><div id="comments" class="comment-list"><div class="comment"><p>Good luck with the bowl, I enjoyed reading this very much.</p></div><div class="comment"><p>What oil do you use on it? I have tried linseed and it went dark.</p></div></div>
<div class="related-posts"><h3>You may also like</h3><ul><li><a href="/x">Sharpening a chisel</a></li><li><a href="/y">The barn roof</a></li></ul></div><footer>&copy; 2020 Workshop</footer></body></html>""",
    """<html lang="de"><body><header><h1><a href="/">Stadtblatt</a></h1></header><nav><ul><li><a href="/p">Politik</a></li><li><a href="/k">Kultur</a></li></ul></nav><!-- ad 3 --><div class="ad">Nur heute billig kaufen.</div>
<article><h1 x>Neue Brücke wird gebaut</h1><p x><b>Im Herbst beginnt der Bau einer neuen Brücke über den Fluss.</b></p><p x>Sie soll in drei Jahren fertig sein und kostet weniger als erwartet.</p><p x>Die Anwohner wurden gefragt und stimmten zu.</p></article><footer>&copy; stadtblatt &middot; Impressum und Datenschutz</footer></body></html>""",
    """<html lang="fr"><body><nav><ul><li><a href="/a">Accueil</a></li><li><a href="/b">Recettes</a></li></ul></nav><div class="ad">Achetez maintenant.</div><article><h1 x>La soupe aux poireaux</h1><p x>Lavez les poireaux et coupez les en morceaux.</p><p x>Faites cuire une heure avec du sel.</p><p x>Servez chaud.</p></article>
<section class="comments"><p>Merci pour la recette, toute la famille a adoré.</p></section><footer>&copy; la table &middot; contact</footer></body></html>""",
    """<html><body><div class="header"><p>Daily science, made simple</p></div><div class="sidebar"><p>About the author: writes on the sea</p><ul><li><a href="/1">Tides</a></li><li><a href="/2">Whales</a></li><li><a href="/3">Ice</a></li></ul></div>
<div class="entry-content"><p x>Sea ice forms when the surface of the ocean cools below its freezing point, which depends on the salt.</p><p x>At first there are only small crystals, which then grow together.</p><div x>Wind and waves break the young ice into round plates.</div></div><div class="popup"><p>Do not miss our offers</p></div></body></html>""",
    """<html><body><nav><ul><li><a href="/The">The</a></li><li><a href="/and">and</a></li></ul></nav><article><h1 x>Short note.</h1><p x>Only this.</p></article><footer>&copy; here.example.com &middot; And there is the rest of it.</footer></body></html>""",
    """<html><body><p><a href="/1">Home</a> | <a href="/2">Archive</a> | <a href="/3">Links</a></p><h1 x>A plain page</h1><p x>This page has no classes at all, only paragraphs that follow each other.</p><p x>It was written by hand many years ago and it is still being read.</p><p x>Nothing else is on it but a row of links above and below.</p><p><a href="/4">Back</a> | <a href="/5">Top</a></p></body></html>""",
    """<html><body><div class="navigation"><a href="/">Start</a></div><div class="article-body"><h1 x>Council approves the budget</h1><p x>The council approved the budget late on Tuesday after a long debate.</p><aside class="ad-box"><p>Advertisement: insure your house with us</p></aside><p x>Spending on schools will rise, and the swimming pool stays open.</p><p x>Two members voted against it.</p></div>
<div class="notice"><p>This site uses trackers, read our policy</p></div><div class="footer-links"><a href="/t">Terms</a> <a href="/p">Privacy</a></div></body></html>""",
)

#: Parts around the main text: their elements, the names they go by, and the blocks in them.
PARTS = {
    "menu": ("nav div ul menu", "nav navbar nav-bar main-nav top-nav topnav menu main-menu top-menu navigation site-navigation breadcrumb breadcrumbs toolbar tabs pagination mainNav", "links links links words"),
    "advert": ("div div aside section", "ad ads advert advertisement ad-box ad-slot banner top-banner promo promo-box sponsored sponsor offer popup modal", "line line para links"),
    "edge": ("header footer aside div section", "header site-header page-header footer site-footer page-footer sidebar side-bar widget related related-posts most-read recommended share share-buttons social masthead copyright", "line links para heading"),
    "talk": ("div section ul", "comments comment-list post-comments comments-area replies discussion responses disqus reader-comments", "comment comment comment line"),
    "notice": ("div section dialog", "cookie-notice cookie-banner cookies consent gdpr newsletter subscribe signup login alert site-notice notice alerts", "line para button line"),
    "form": ("form form fieldset", "search-form contact-form newsletter-form login-form", "line button"),
}
#: Names of the main text's own element, and of wrappers that say nothing about what is in them.
CONTENT = "content article article-body entry entry-content post post-body story main main-content text prose page-content body articleBody story-text".split()
NEUTRAL = "wrapper container page site layout row column inner outer section region block group grid".split()
STATES = "open closed fixed sticky enabled disabled collapsed expanded hidden visible".split()


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(["word"] * r.randint(low, high))


def _named(r: random.Random, element: str, *names: str) -> str:
    names = " ".join(x for x in names if x)
    return f'<{element} {r.choice(("class", "class", "class", "id"))}="{names}">' if names else f"<{element}>"


def _block(r: random.Random, kind: str) -> str:
    if kind == "links":
        items = [f'<a href="/">{_words(r, 1, 4)}</a>' for _ in range(r.randint(2, 6))]
        return "<ul><li>" + "</li><li>".join(items) + "</li></ul>" if r.random() < 0.6 else r.choice((" ", " | ")).join(items)
    if kind == "words":
        return "".join(f"<li>{_words(r, 1, 2)}</li>" for _ in range(3))
    if kind == "heading":
        return f"<h3>{_words(r, 1, 4)}</h3>"
    if kind == "button":
        return f"<input><button>{_words(r, 1, 2)}</button>"
    if kind == "comment":
        inner = f"<p>{_words(r, 3, 40)}</p>"
        inner = r.choice((inner, inner, f'<div class="content">{inner}</div>', f'<div class="text">{inner}</div>'))
        return r.choice(("<div class='comment'>{}</div>", "<article class='comment-body'>{}</article>", "<li class='comment'>{}</li>", "<div class='reply'>{}</div>", "{}")).format(inner)
    return r.choice(("{}", "<p>{}</p>", "<p>{}</p>", "<span>{}</span>")).format(_words(r, 2, 10) if kind == "line" else _words(r, 10, 40))


def _part(r: random.Random, kind: str) -> str:
    elements, names, blocks = (x.split() for x in PARTS[kind])
    element = r.choice(elements)
    tells = element in ("nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset")
    name = "" if tells and r.random() < 0.6 else r.choice(names)
    body = "".join(_block(r, r.choice(blocks)) for _ in range(r.randint(1, 4)))
    if r.random() < 0.2:
        body = _named(r, "div", r.choice(("content", "inner", "wrapper", "text", "body"))) + body + "</div>"
    return _named(r, element, name) + body + f"</{element}>"


def _content(r: random.Random) -> str:
    out = [f"<h1 x>{_words(r, 2, 10)}</h1>"] if r.random() < 0.8 else []
    if out and r.random() < 0.15:
        out = [f"<header>{out[0]}</header>"]
    for _ in range(r.randint(1, 8)):
        kind = r.random()
        if kind < 0.62:
            some = _words(r, 3, 60)
            out.append(f"<p x>{some.replace('word word word', '<a>word</a> <b>word</b> word', 1) if r.random() < 0.4 else some}</p>")
        elif kind < 0.72:
            out.append("<ul>" + "".join(f"<li x>{r.choice(('{}', '<a>{}</a>', '<p>{}</p>')).format(_words(r, 2, 14))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
        elif kind < 0.78:
            out.append(f"<h2 x>{_words(r, 1, 7)}</h2>")
        elif kind < 0.84:
            out.append(r.choice(("<blockquote x>{}</blockquote>", "<blockquote x><p>{}</p></blockquote>", "<pre x>{}</pre>", "<div x>{}</div>", "<figure><figcaption x>{}</figcaption></figure>")).format(_words(r, 2, 20)))
        elif kind < 0.88:
            out.append("<table>" + "".join(f"<tr><td x>{_words(r, 1, 3)}</td><td x>{_words(r, 1, 3)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            out.append(_part(r, r.choice(("advert", "advert", "form", "edge", "notice", "talk", "menu"))))
    return "".join(out)


def _wrapper(r: random.Random) -> str:
    """A name that tells how a page is set, not what an element is."""
    kind = r.choice("nav menu comments sidebar ads header footer banner newsletter login cookie".split())
    return r.choice((r.choice(NEUTRAL), f"{kind}-{r.choice(STATES)}", f"{r.choice(('has', 'with', 'no'))}-{kind}", f"page-with-{kind}", f"{r.choice(NEUTRAL)}-{r.choice(NEUTRAL)}"))


def drawn_page(r: random.Random) -> str:
    body = _content(r)
    element, kind = r.choice(("article", "article", "main", "div", "div", "section")), r.random()
    name = "" if element in ("article", "main") and r.random() < 0.6 else r.choice(CONTENT)
    extra = _wrapper(r) if r.random() < 0.4 else f"{r.choice(CONTENT)}-with-{r.choice(('comments', 'sidebar', 'ads'))}" if r.random() < 0.1 else ""
    if kind < 0.08 and element not in ("article", "main"):
        name, extra = r.choice(CONTENT), r.choice(("alert", "notice", "tabs", "menu", "login"))
    body = _named(r, element, *r.sample((name, extra), 2)) + body + f"</{element}>" if kind < 0.93 else body
    if kind > 0.8 and element in ("article", "main"):  # a wrapper whose name misleads
        body = _named(r, "div", r.choice(("alert", "tabs", "notice", "menu", "banner", "widget", "login"))) + body + "</div>"
    elif kind > 0.75:
        body = _named(r, "div", r.choice(("tabs", "menu", "alert", "notice"))) + _named(r, "div", "content") + body + "</div></div>"
    for _ in range(r.randint(0, 2)):
        element = r.choice(("div", "div", "section"))
        body = _named(r, element, _wrapper(r) if r.random() < 0.8 else "") + body + f"</{element}>"
    if r.random() < 0.15:
        body = f"<p>{_block(r, 'links')}</p>" + body + (f"<p>{_block(r, 'links')}</p>" if r.random() < 0.5 else "")
    before = [_part(r, k) for k in r.sample(("menu", "advert", "edge", "notice", "form"), r.randint(1, 3))]
    after = [_part(r, k) for k in r.sample(("talk", "edge", "advert", "notice", "form", "menu", "talk"), r.randint(1, 4))]
    page = "".join(before[1:]) + body + "".join(after[:-1])
    if r.random() < 0.5:  # most of the page in one element
        name = r.choice((*NEUTRAL, "content", "main", "main-content", "page-content", _wrapper(r)))
        page = _named(r, "div", name) + page + "</div>"
    return "<html><body>" + before[0] + page + after[-1] + "</body></html>"


def labelled_pages(drawn: int = 1500, seed: int = 11) -> Iterator[str]:
    """The pages written by hand, then ``drawn`` others."""
    yield from PAGES
    r = random.Random(seed)
    for _ in range(drawn):
        yield drawn_page(r)
