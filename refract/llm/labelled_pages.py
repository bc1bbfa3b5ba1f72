"""Labelled pages for the block classifier, put together from a rule.

A page is an article in one of the usual forms of markup, with the parts that
stand around it (navigation, notices, adverts, sidebars, comments, related
cards, forms, footers), each in several forms.  The attribute ``y`` says of an
element's blocks whether they belong to the main text.  Words carry no meaning,
only how many there are; names and elements are those that sites use.
"""

from __future__ import annotations

import random

NAV = ["<nav{y}>{0}</nav>", "<div class=menu{y}>{0}</div>", "<div id=navigation{y}>{0}</div>", "<div class=navbar role=navigation{y}>{0}</div>", "<div{y}>{0}</div>",
       "<table{y}><tr><td>{0}</td></tr></table>", "<div class='breadcrumbs'{y}>{0}</div>"]
TOP = ["<header{y}>{0}</header>", "<div id=header{y}>{0}</div>", "<div class='top-bar'{y}>{0}</div>", "<div class=masthead{y}>{0}</div>", "<header class=site-header{y}>{0}</header>"]
NOTICE = ["cookie-notice", "cookie-banner", "notification", "alert alert-info", "gdpr", "cc-window", "consent", "notice", "site-notice", "popup", "banner", "privacy-notice"]
ADVERT = ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "adsbygoogle"]
SIDE = ["<aside{y}>{0}</aside>", "<div class=sidebar{y}>{0}</div>", "<div id=secondary class=widget-area{y}>{0}</div>", "<div class='sidebar-right col'{y}>{0}</div>",
        "<section class=widget{y}>{0}</section>", "<td class=sidebar{y}>{0}</td>", "<div class=rail{y}>{0}</div>"]
COMMENTS = ["comments", "comment-list", "user-feedback", "responses", "discussion", "disqus_thread", "comments-area", "reader-comments", "replies"]
RELATED = ["related", "recommended", "more-stories related-posts", "read-next", "related-articles"]
FORM = ["newsletter", "signup", "search", "login", "subscribe", "contact"]
FOOT = ["<footer{y}>{0}</footer>", "<div id=footer{y}>{0}</div>", "<div class=site-info{y}>{0}</div>", "<div class=colophon{y}>{0}</div>", "<footer class=site-footer{y}>{0}</footer>",
        "<div class=copyright{y}>{0}</div>", "<div class='foot'{y}>{0}</div>"]
BODY = ["<article{y}>{0}</article>", "<main{y}>{0}</main>", "<div class=content{y}>{0}</div>", "<div id=content{y}>{0}</div>", "<div class='post-content'{y}>{0}</div>",
        "<div class='entry-content'{y}>{0}</div>", "<div class='article-body'{y}>{0}</div>", "<div class=story{y}>{0}</div>", "<div{y}>{0}</div>", "<div{y}>{0}</div>",
        "<section{y}>{0}</section>", "<main><article{y}>{0}</article></main>", "<article><div class=body{y}>{0}</div></article>", "<div class='post hentry'{y}>{0}</div>",
        "<article class='post has-sidebar no-comments'{y}>{0}</article>", "<div itemprop=articleBody{y}>{0}</div>", "<div><div><div{y}>{0}</div></div></div>",
        "<table><tr><td{y}>{0}</td></tr></table>"]
WRAP = ["{0}", "{0}", "{0}", "<div class='wrapper has-sidebar'>{0}</div>", "<div id=content-sidebar-wrap>{0}</div>", "<form id=aspnetForm>{0}</form>", "<form id=form1>{0}</form>",
        "<div class=page>{0}</div>", "<div class='site container'>{0}</div>", "<div class='layout with-nav'>{0}</div>", "<div id=page-footer-push>{0}</div>",
        "<div class='row ad-free'>{0}</div>", "<div class='main-menu-offset'>{0}</div>", "<div class='cookie-wall-off site'>{0}</div>"]
HEAD = ["<h1>{0}</h1>", "<h1>{0}</h1>", "<header><h1>{0}</h1></header>", "<div class=entry-header><h1>{0}</h1></div>", "<header class=article-header><h1>{0}</h1><p>{1}</p></header>",
        "<div class=headline><h1>{0}</h1></div>", "<div class=title>{0}</div>", "<h2>{0}</h2>", "<hgroup><h1>{0}</h1><p>{1}</p></hgroup>", ""]
YES, NO = " y=1", " y=0"


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def w(self, least: int, most: int) -> str:
        return " ".join(["word"] * self.r.randint(least, most))

    def a(self, least: int = 1, most: int = 4) -> str:
        return f"<a href=x>{self.w(least, most)}</a>"

    def some(self, chance: float, f) -> str:
        return f() if self.r.random() < chance else ""

    def put(self, forms: list[str], y: str, *parts: str) -> str:
        return self.r.choice(forms).replace("{y}", y).format(*parts)

    def links(self) -> str:
        n = self.r.randint(2, 9)
        form = self.r.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{self.a()}</li>" for _ in range(n)) + "</ul>"
        if form == 1:
            return " | ".join(self.a() for _ in range(n))
        if form == 2:
            return "".join(f"<div>{self.a()}</div>" for _ in range(n))
        return "".join(f"<li>{self.a()}" for _ in range(n))

    def text(self) -> str:
        """A paragraph or what else stands between paragraphs."""
        k = self.r.random()
        if k < 0.55:
            p = self.w(8, 120)
        elif k < 0.7:
            p = self.w(1, 8)
        elif k < 0.8:
            p = f"{self.w(5, 40)} {self.a(1, 8)} {self.w(0, 30)}"
        elif k < 0.84:
            p = self.a(3, 10)
        else:
            return self.r.choice([
                f"<h2>{self.w(1, 8)}</h2>", f"<h3>{self.w(1, 6)}</h3>", f"<blockquote><p>{self.w(6, 50)}</p></blockquote>", f"<pre>{self.w(3, 60)}</pre>",
                "<ul>" + "".join(f"<li>{self.w(1, 14)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>",
                "<ol>" + "".join(f"<li>{self.a(1, 4)} {self.w(0, 9)}</li>" for _ in range(self.r.randint(2, 5))) + "</ol>",
                f"<table><tr><th>{self.w(1, 2)}</th><th>{self.w(1, 2)}</th></tr><tr><td>{self.w(1, 4)}</td><td>{self.w(1, 4)}</td></tr></table>",
                f"<figure><img src=x><figcaption>{self.w(2, 14)}</figcaption></figure>", f"<dl><dt>{self.w(1, 3)}</dt><dd>{self.w(4, 20)}</dd></dl>"])
        return self.r.choice(["<p>{0}</p>", "<p>{0}</p>", "<p>{0}</p>", "<p>{0}", "<div>{0}</div>", "<p><b>{0}<br>"]).format(p)

    def notice(self) -> str:
        return f"<div class='{self.r.choice(NOTICE)}'{NO}>" + self.r.choice(["<p>{0}</p>", "{0}", "<p>{0}</p><p>{1}</p>", "{0} {1}"]).format(self.w(3, 40), self.a()) + "</div>"

    def advert(self) -> str:
        return f"<div class='{self.r.choice(ADVERT)}'{NO}>" + self.r.choice(["{0}", "<p>{0}</p>", "<h4>{1}</h4><p>{0}</p>"]).format(self.w(3, 40), self.a(1, 6)) + "</div>"

    def side(self) -> str:
        parts = "".join(self.r.choice([f"<h3>{self.w(1, 4)}</h3>", f"<p>{self.w(3, 60)}</p>", self.links(), f"<div>{self.w(2, 25)}</div>"]) for _ in range(self.r.randint(1, 5)))
        return self.put(SIDE, NO, parts)

    def comments(self) -> str:
        form = self.r.choice(["<article class=comment><p>{0}</p></article>", "<li class=comment><div>{0}</div>", "<div class=comment-body><p>{0}</p><p>{1}</p></div>",
                              "<article><footer>{2}</footer><p>{0}</p></article>", "<p>{0}</p>", "<div class=reply>{0}</div>"])
        parts = "".join(form.format(self.w(1, 80), self.w(1, 40), self.w(1, 4)) for _ in range(self.r.randint(1, 8)))
        return f"<{(t := self.r.choice(['section', 'div', 'div']))} {self.r.choice(['id', 'class'])}='{self.r.choice(COMMENTS)}'{NO}><h3>{self.w(1, 3)}</h3>{parts}</{t}>"

    def related(self) -> str:
        card = self.r.choice(["<article><h3>{0}</h3><p>{1}</p></article>", "<li>{0}</li>", "<div class=card>{0}<p>{1}</p></div>", "<p>{0}</p>"])
        parts = "".join(card.format(self.a(3, 9), self.w(4, 25)) for _ in range(self.r.randint(1, 5)))
        return f"<div class='{self.r.choice(RELATED)}'{NO}><h2>{self.w(1, 3)}</h2>{parts}</div>"

    def form(self) -> str:
        return f"<form class='{self.r.choice(FORM)}'{NO}><label>{self.w(1, 6)}</label><p>{self.w(2, 20)}</p><input name=q></form>"

    def foot(self) -> str:
        parts = self.r.choice(["{0}", "<p>{0}</p>", "<p>{0}</p><ul><li>{1}<li>{1}</ul>", "{1} {1} {0}", "<div>{0}</div><div>{1}</div>"])
        return self.put(FOOT, NO, parts.format(self.w(2, 40), self.a(1, 3)))

    def page(self) -> str:
        some, r = self.some, self.r
        paragraphs = [self.text() for _ in range(r.choice([1, 2, 2, 3, 3, 4, 5, 6, 8, 10, 14, 20]))]
        if not any(p.count("word") > 7 for p in paragraphs):
            paragraphs[0] = f"<p>{self.w(12, 60)}</p>"
        if r.random() < 0.1:                               # each in a holder of its own
            paragraphs = [f"<div>{p}</div>" for p in paragraphs]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):      # what stands inside the article
            paragraphs.insert(r.randint(0, len(paragraphs)), r.choice([self.advert, self.advert, self.related, self.form, lambda: f"<aside{NO}>{self.w(4, 40)}</aside>"])())
        article = self.put(BODY, YES, r.choice(HEAD).format(self.w(2, 12), self.w(3, 20)) + "".join(paragraphs))
        top = some(0.5, lambda: self.put(TOP, NO, f"<div>{self.w(1, 5)}</div>" + some(0.5, self.links))) + some(0.7, lambda: self.put(NAV, NO, self.links()))
        before, after = some(0.25, self.notice) + some(0.25, self.advert), some(0.3, self.comments) + some(0.3, self.related) + some(0.2, self.form)
        side = some(0.35, self.side)
        middle = before + (side + article if r.random() < 0.3 else article + side) + after if r.random() < 0.7 else before + article + after + side
        whole = r.choice(WRAP).format(top + middle + some(0.75, self.foot) + some(0.1, self.notice))
        if r.random() < 0.06:                              # nothing but paragraphs
            form = r.choice(["<p>{0}</p>", "<p>{0}</p>", "<div>{0}</div>", "<div><p>{0}</p></div>"])
            whole = f"<div{YES}>" + some(0.5, lambda: f"<h1>{self.w(2, 9)}</h1>") + "".join(form.format(self.w(3, 80)) for _ in range(r.randint(1, 5))) + "</div>"
            whole = whole if r.random() < 0.5 else whole.replace(f"<div{YES}>", "", 1)[:-6]
        y = "" if NO in whole or YES in whole else YES
        return f"<html><head><title>{self.w(1, 8)}</title></head><body{y}>{whole}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    w = Writer(seed)
    return [w.page() for _ in range(n)]
