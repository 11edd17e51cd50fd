"""Labelled pages to train the extraction of main texts.

Two kinds: pages put together from fixed building blocks, each marked as main text or not, and a bounded
sample of the given pages that mark up their own article, each with its markup and with all that names it hidden.
"""

from __future__ import annotations

import random
import re

#: An attribute that carries the label of an element's blocks.
LABEL = re.compile(r'data-label="(main|other)"')

#: Elements that hold main texts.
MAIN = ["article", 'article class="post"', "main", 'main id="main"', 'div class="post-content"', 'div class="entry-content"', 'div id="content"',
        'div class="article-body"', 'div class="story text"', 'section class="content"', 'td class="main"', "div", 'div class="markdown-body"',
        'div class="page body"', 'div role="main"', 'section class="article"', "body"]
#: Elements around or inside the main text that are none of it, and the kind of their text.
OTHER = [
    ("nav", "links"), ('div class="menu"', "links"), ('ul class="navbar"', "items"), ('div id="navigation"', "links"), ('div class="breadcrumb"', "links"),
    ('div class="pagination pager"', "links"), ('div class="toc"', "links"), ('div role="navigation"', "links"), ('div class="toolbar topbar"', "links"),
    ("header", "short"), ('div class="header"', "short"), ('div id="site-header masthead"', "short"), ('div class="logo site-title"', "short"), ('div role="banner"', "short"),
    ("footer", "rights"), ('div class="footer"', "rights"), ('div id="bottom"', "rights"), ('div class="copyright legal"', "rights"), ('div role="contentinfo"', "rights"),
    ("aside", "mixed"), ('div class="sidebar"', "mixed"), ('div class="widget"', "mixed"), ('div id="left column"', "mixed"), ('div role="complementary"', "mixed"),
    ('div class="related recommended"', "links"), ('div class="trending popular"', "links"), ('div class="read-more"', "links"), ('div class="teaser"', "mixed"),
    ('div class="cookie-notice"', "notice"), ('div class="notice"', "notice"), ('div class="alert warning"', "notice"), ('div class="consent gdpr"', "notice"),
    ('div class="popup modal overlay"', "notice"), ("dialog", "notice"), ('div role="alert"', "notice"), ('div class="message info"', "notice"),
    ('div class="ad"', "prose"), ('div class="advert"', "prose"), ('div class="advertisement"', "prose"), ('div class="sponsored sponsor"', "prose"),
    ('div class="promo promotion"', "prose"), ('ins class="adsbygoogle"', "prose"), ('div class="banner"', "prose"), ('aside class="ad"', "prose"), ('div id="ad-slot"', "prose"),
    ("form", "form"), ('form class="newsletter"', "form"), ('div class="subscribe signup"', "form"), ('div class="login"', "form"), ('div class="search"', "form"),
    ('div role="search"', "form"), ('section class="comments"', "comments"), ('div id="comments"', "comments"), ('div class="comment-list"', "comments"),
    ('ol class="commentlist"', "comments"), ('div class="discussion replies"', "comments"), ('div id="disqus_thread"', "comments"), ('div class="reply respond"', "comments"),
    ('div class="reader-comments"', "comments"), ('section class="responses feedback"', "comments"), ('div class="share social"', "links"), ('div class="tags categories"', "links"),
    ('div class="author bio"', "prose"), ('div class="disclaimer"', "prose"),
]
#: Short texts of such elements.
SHORT = ["Home", "About us", "Contact", "News", "Sport", "Archive", "Login", "Register", "Privacy", "Terms of use", "Next page", "Previous", "Read more",
         "Share this", "Tweet", "Print", "Startseite", "Kontakt", "Impressum", "Accueil", "Inicio", "Suche", "Menu", "Skip to content", "Tags", "Top"]
RIGHTS = ["© 2021 Example. All rights reserved.", "&copy; example.org &middot; {p}", "Copyright 2019 {s}", "Powered by {s}", "&copy; {s}"]
NOTICE = ["We use cookies to improve this site. {p}", "This site uses cookies. Accept", "Please enable JavaScript.", "{p}", "Subscribe now to read on. {p}", "You have read 3 of 5 free articles."]
FORM = ['<label>Email</label><input type="text"><button>Subscribe</button>', '<p>Sign up for our newsletter. {p}</p><input><button>Send</button>',
        '<label>Search</label><input><select><option>All</option><option>News</option></select>', "Sign up <input><button>Go</button>", "{p} <input>", "<label>Name</label><input><label>Password</label><input><button>Log in</button><p>{p}</p>"]
SYLLABLES = "th er on an re he in en ti at es ou ing ent al sch ei un der que la le ción os ge ver st ch".split()


class Writer:
    """Puts labelled pages together; the same seed gives the same pages."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rnd.choices(SYLLABLES, k=self.rnd.randint(1, 4)))

    def prose(self, most: int = 60) -> str:
        n = self.rnd.choice([1, 2, 4, 8, 16, 30, most])
        out, left = [], self.rnd.randint(max(1, n // 2), n)
        while left > 0:
            k = min(left, self.rnd.randint(1, 16))
            words = [self.word() for _ in range(k)]
            if k > 6 and self.rnd.random() < 0.5:
                words[k // 2] += ","
            out.append(" ".join(words).capitalize() + self.rnd.choice([".", ".", ".", "?", "!", "", ".&quot;"]))
            left -= k
        return " ".join(out)

    def fill(self, text: str) -> str:
        return text.replace("{p}", self.prose(30)).replace("{s}", self.word().capitalize())

    def links(self, item: str = "{}") -> str:
        return "".join(item.format(f'<a href="/{self.word()}">{self.rnd.choice(SHORT) if self.rnd.random() < 0.4 else self.word()}</a>')
                       for _ in range(self.rnd.randint(1, 7)))

    def other(self, inside: bool = False) -> str:
        opening, kind = self.rnd.choice(OTHER)
        name = opening.split()[0]
        pick = self.rnd.random()
        if kind == "links":
            body = ("<ul>" + self.links("<li>{}</li>") + "</ul>") if pick < 0.6 else self.links("{} | ") if pick < 0.8 else "<h4>" + self.rnd.choice(SHORT) + "</h4>" + self.links("<p>{}</p>")
        elif kind == "items":
            body = self.links("<li>{}</li>")
        elif kind == "short":
            body = f"<h2>{self.prose(4)}</h2>" if pick < 0.3 else self.prose(8) if pick < 0.6 else f'<a href="/">{self.word()}</a><p>{self.prose(8)}</p>'
        elif kind == "rights":
            body = self.fill(self.rnd.choice(RIGHTS)) if pick < 0.5 else f"<p>{self.fill(self.rnd.choice(RIGHTS))}</p>" + self.links()
        elif kind == "notice":
            body = self.fill(self.rnd.choice(NOTICE))
            body = body if pick < 0.5 else f"<p>{body}</p><button>OK</button>"
        elif kind == "form":
            body = self.fill(self.rnd.choice(FORM))
        elif kind == "comments":
            item = "li" if name == "ol" else "div"
            body = ("" if pick < 0.5 else "<h3>Comments</h3>") + "".join(
                f'<{item}{self.rnd.choice(["", " class=comment"])}><b>{self.word()}</b> <p>{self.prose()}</p>' + (f"<p>{self.prose()}</p>" if self.rnd.random() < 0.3 else "") + f"</{item}>"
                for _ in range(self.rnd.randint(1, 4)))
        else:
            body = self.prose(40) if pick < 0.4 else "".join(f"<p>{self.prose(40)}</p>" for _ in range(self.rnd.randint(1, 2)))
            if kind == "mixed":
                body = f"<h3>{self.prose(4)}</h3>{body}<ul>" + self.links("<li>{}</li>") + "</ul>"
        return f'<{opening} data-label="other">{body}</{name}>'

    def part(self) -> str:
        pick = self.rnd.random()
        if pick < 0.6:
            text = self.prose(120)
            if self.rnd.random() < 0.2:
                text = text.replace(" ", f' <a href="/x">{self.word()}</a> ', 1)
            if self.rnd.random() < 0.1:
                text = f"<b>{self.prose(12)}<br>" + text
            return f"<p>{text}</p>" if self.rnd.random() < 0.9 else f"<p>{text}"
        if pick < 0.72:
            return f"<h2>{self.prose(8)}</h2>"
        if pick < 0.8:
            return "<ul>" + "".join(f"<li>{self.prose(16)}</li>" for _ in range(self.rnd.randint(2, 5))) + "</ul>"
        if pick < 0.86:
            return f"<blockquote>{self.prose(40)}</blockquote>"
        if pick < 0.9:
            return f"<pre>{self.prose(20)}</pre>"
        if pick < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.prose(4)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        return f"<figure><figcaption>{self.prose(12)}</figcaption></figure>"

    def page(self) -> str:
        opening = self.rnd.choice(MAIN)
        name = opening.split()[0]
        title = self.prose(12)
        parts = [f"<h1>{title}</h1>"] if self.rnd.random() < 0.8 else []
        if self.rnd.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"] if parts else []
        for _ in range(self.rnd.choice([0, 1, 1, 2, 3, 5, 8, 13])):
            parts.append(self.part())
        for _ in range(self.rnd.choice([0, 0, 1, 1, 2, 3])):
            parts.insert(self.rnd.randint(0, len(parts)), self.other())
        around = [[self.other() for _ in range(self.rnd.choice([0, 1, 2, 3]))] for _ in range(2)]
        wrap = self.rnd.choice([("", ""), ("<div>", "</div>"), ('<div class="container">', "</div>"), ('<div id="wrapper"><div class="row">', "</div></div>")])
        if name == "body":
            body = f'{"".join(around[0])}<span data-label="main"></span>' + "".join(re.sub(r"^<(\w+)(?![^>]*data-label)", r'<\1 data-label="main"', p) for p in parts) + "".join(around[1])
            return f"<html><head><title>{title}</title></head><body>{body}</body></html>"
        if name == "td":
            wrap = ("<table><tr><td>", "</td></tr></table>")
            around = [around[0], []]
            return (f"<html><body>{wrap[0]}{''.join(around[0])}</td><{opening} data-label=\"main\">{''.join(parts)}{wrap[1]}</body></html>")
        if self.rnd.random() < 0.15:
            parts = ["<div>", *parts, "</div>"] if name in ("article", "main") else ["<article>", *parts, "</article>"]
        return (f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{wrap[0]}{''.join(around[0])}<{opening} data-label=\"main\">"
                f"{''.join(parts)}</{name}>{''.join(around[1])}{wrap[1]}</body></html>")


def written_pages(n: int, seed: int = 11) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]


_NAMED = re.compile(r"<(article|main|nav|footer|header|aside|form)\b([^>]*)>", re.I)
_CLOSED = re.compile(r"</(article|main|nav|footer|header|aside|form)\s*>", re.I)
_NAMES = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def marked(page: str) -> list[str]:
    """A page that marks up its article, labelled by that markup: as it is, and with all names of elements, classes and ids
    hidden. Nothing for other pages."""
    if not re.search(r"<(?:article|main)\b", page, re.I):
        return []
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", page)
    if "data-label" in body:
        return []

    def label(m):
        return "main" if m[1].lower() in ("article", "main") else "other"

    bare = _NAMES.sub("", body)
    return [_NAMED.sub(lambda m: f'<{m[1]} data-label="{label(m)}"{m[2]}>', body),
            _CLOSED.sub("</div>", _NAMED.sub(lambda m: f'<div data-label="{label(m)}">', bare))]
