"""Layouts to learn from: the words of real pages set anew, with a mark on what is article and what is not."""

from __future__ import annotations

import html
import random
from dataclasses import dataclass

from tidewatch.llm.dom import Page

# Names that sites give to parts of their pages, as class, id or role.
ARTICLE_NAMES = (
    "content main article post entry story article-body article-content post-content post-body entry-content main-content page-content story-body body-text text "
    "articleBody mainContent markdown-body prose hentry single-post blog-post news-article documentation primary read-content story-text detail"
).split()
NAV_NAMES = "nav menu navbar navigation main-menu site-nav topnav primary-menu nav-links breadcrumb breadcrumbs pagination pager tabs toc mega-menu tags tag-list categories skip-links lang-switch".split()
HEADER_NAMES = "header masthead site-header top topbar page-header banner logo branding head hero".split()
FOOTER_NAMES = "footer site-footer page-footer colophon bottom copyright legal foot footer-links imprint disclaimer".split()
SIDE_NAMES = "sidebar side aside widget widget-area rail right-column left-column secondary complementary related related-posts recommended popular trending most-read read-more more-stories latest teaser-list author-box bio".split()
NOTICE_NAMES = "notice cookie cookie-notice cookie-banner cookie-consent consent gdpr privacy-banner alert message popup modal overlay toast subscribe newsletter paywall warning info-bar announcement".split()
AD_NAMES = "ad ads advert advertisement sponsored sponsor promo promoted promotion ad-slot ad-container banner-ad adsbygoogle partner taboola outbrain commercial dfp affiliate".split()
FORM_NAMES = "form search search-form login signup contact-form comment-form respond newsletter-form poll survey".split()
COMMENT_NAMES = "comments comment comment-list reader-comments responses replies discussion disqus disqus-thread feedback user-comments comment-section reviews thread".split()
SHARE_NAMES = "share social share-buttons social-links sharing follow-us sharedaddy addthis print-links tools".split()
NEUTRAL_NAMES = "wrapper wrap container page site inner outer row col block box section layout grid root app clearfix module group panel region view column".split()
OFFERS = ("nav", "side", "ad", "notice", "form", "share", "comments", "related")


@dataclass
class Material:
    paragraphs: list[str]
    phrases: list[str]


def material(pages: list[Page]) -> Material:
    """Paragraphs and short phrases of the sampled pages; made of letters where they have none."""
    paragraphs, phrases = [], []
    for p in pages:
        for t in p.run_text:
            t = " ".join(t.split())
            words = t.split(" ")
            if len(words) > 6:
                paragraphs.append(t)
                phrases.append(" ".join(words[: 1 + len(t) % 5]))
            elif t:
                phrases.append(t)
    if not phrases:
        phrases = [a * 2 + b for a in "aeiou" for b in "lmnrst"]
    if not paragraphs:
        paragraphs = [". ".join(", ".join(phrases[(k + j) % len(phrases)] for j in range(12)) for _ in range(1 + k % 3)) + "." for k in range(20)]
    return Material(paragraphs, phrases)


def layout(words: Material, rng: random.Random, mark: str) -> str:
    """One page. Every part carries ``mark`` 1 (article) or 0; elements around both carry none."""
    return _Layout(words, rng, mark).page()


class _Layout:
    def __init__(self, words: Material, rng: random.Random, mark: str):
        self.words, self.rng, self.mark = words, rng, mark

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def paragraph(self) -> str:
        r = self.rng
        t = r.choice(self.words.paragraphs)
        w = t.split(" ")
        kind = r.random()
        if kind < 0.15:
            w = w[: r.randint(1, 4)]
        elif kind < 0.4:
            w = w[: r.randint(5, 25)]
        elif kind < 0.5:
            w = w + r.choice(self.words.paragraphs).split(" ")
        w = [html.escape(x) for x in w]
        if len(w) > 4 and self.chance(0.3):
            k = r.randrange(len(w) - 2)
            tag = r.choice(["b", "em", "strong", "i", 'a href="/x"', 'a href="/y" class="link"', "code", 'span class="hl"', "sup"])
            w[k] = f"<{tag}>{w[k]}"
            w[k + r.randint(0, 1)] += f"</{tag.split(' ')[0]}>"
        if len(w) > 8 and self.chance(0.05):
            w.insert(r.randrange(len(w)), "<br>")
        return " ".join(w)

    def phrase(self) -> str:
        return html.escape(self.rng.choice(self.words.phrases))

    def named(self, names: list[str], also_role: str = "", p: float = 1.0) -> str:
        """Class or id, by chance with further words or a neutral one."""
        r = self.rng
        if not self.chance(p):
            return ""
        if also_role and self.chance(0.12):
            return f' role="{also_role}"'
        name = r.choice(names)
        kind = r.random()
        if kind < 0.15:
            name = name.replace("-", "_")
        elif kind < 0.25:
            name = f"{r.choice(NEUTRAL_NAMES)}-{name}"
        elif kind < 0.35:
            name = f"{name} {r.choice(NEUTRAL_NAMES)}"
        elif kind < 0.4:
            name = f"{name}-{r.randint(1, 9)}"
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int, sep: str = " ") -> str:
        return sep.join(f'<a href="/{k}">{self.phrase()}</a>' for k in range(n))

    def listed(self, n: int) -> str:
        kind = self.rng.choice(["ul", "ul", "ol"])
        own = self.named(NAV_NAMES, p=0.2)
        return f"<{kind}{own}>" + "".join(f'<li><a href="/{k}">{self.phrase()}</a></li>' for k in range(n)) + f"</{kind}>"

    # --- surroundings ---------------------------------------------------------------------------------------------

    def nav(self) -> str:
        r = self.rng
        n = r.randint(1, 12)
        body = r.choice([lambda: self.listed(n), lambda: self.links(n), lambda: self.links(n, " | "), lambda: f"<p>{self.links(n)}</p>", lambda: "".join(f"<div>{self.links(1)}</div>" for _ in range(n))])()
        if self.chance(0.5):
            return self.box("nav", self.named(NAV_NAMES, p=0.4), body)
        return self.box(r.choice(["div", "div", "section"]), self.named(NAV_NAMES, "navigation"), body)

    def box(self, tag: str, attributes: str, body: str, y: str = "0") -> str:
        return f'<{tag}{attributes} {self.mark}="{y}">{body}</{tag}>'

    def prose(self, most: int = 3) -> str:
        """Text of surroundings, up to whole paragraphs, so that length alone decides nothing."""
        n = self.rng.randint(1, most)
        if self.chance(0.4):
            return self.paragraph()
        return "".join(f"<p>{self.paragraph()}</p>" for _ in range(n))

    def header(self) -> str:
        r = self.rng
        parts = [r.choice([f"<h1>{self.phrase()}</h1>", f"<a href=\"/\">{self.phrase()}</a>", f"<p>{self.phrase()}</p>", f"<div{self.named(HEADER_NAMES)}>{self.phrase()}</div>"])]
        if self.chance(0.4):
            parts.append(f"<p>{self.paragraph()}</p>")
        if self.chance(0.5):
            parts.append(self.nav())
        if self.chance(0.2):
            parts.append(self.form())
        tag = r.choice(["header", "header", "div"])
        return self.box(tag, self.named(HEADER_NAMES, "banner", 0.4 if tag == "header" else 1), "".join(parts))

    def footer(self) -> str:
        r = self.rng
        parts = [r.choice([f"&copy; {r.randint(1998, 2030)} {self.phrase()} &middot; {self.paragraph()}", f"<p>&copy; {self.phrase()}</p>", f"<p>{self.paragraph()}</p>", self.paragraph(), f"<div>{self.links(r.randint(1, 6))}</div>"])]
        if self.chance(0.4):
            parts.append(self.listed(r.randint(2, 8)))
        if self.chance(0.2):
            parts.append(self.prose())
        tag = r.choice(["footer", "footer", "div"])
        return self.box(tag, self.named(FOOTER_NAMES, "contentinfo", 0.3 if tag == "footer" else 1), "".join(parts))

    def side(self) -> str:
        r = self.rng
        parts = []
        for _ in range(r.randint(1, 3)):
            head = f"<h{r.randint(2, 4)}>{self.phrase()}</h{2}>" if self.chance(0.6) else ""
            parts.append(head + r.choice([lambda: self.listed(r.randint(2, 8)), lambda: self.prose(), lambda: f"<div{self.named(SIDE_NAMES)}>{self.prose()}</div>", self.ad])())
        tag = r.choice(["aside", "aside", "div", "section"])
        return self.box(tag, self.named(SIDE_NAMES, "complementary", 0.4 if tag == "aside" else 1), "".join(parts))

    def related(self) -> str:
        r = self.rng
        cards = "".join(f"<{t}{self.named(SIDE_NAMES, p=0.5)}><h3><a href=\"/{k}\">{self.phrase()}</a></h3><p>{self.paragraph()}</p></{t}>" for k, t in enumerate(r.choices(["article", "div", "li"], k=r.randint(1, 5))))
        body = r.choice([cards, self.listed(r.randint(2, 8))])
        return self.box(r.choice(["div", "section", "aside"]), self.named(SIDE_NAMES), f"<h2>{self.phrase()}</h2>{body}")

    def notice(self) -> str:
        r = self.rng
        button = r.choice(["", f"<button>{self.phrase()}</button>", f'<a href="#">{self.phrase()}</a>'])
        hidden = r.choice(["", "", "", ' style="display:none"', " hidden"])
        tag = r.choice(["div", "div", "section", "p", "dialog", "aside"])
        body = f"{self.paragraph()} {button}" if tag == "p" else self.prose(2) + button
        if tag == "dialog" and self.chance(0.5):
            return self.box("dialog", hidden, body)
        return self.box(tag, self.named(NOTICE_NAMES, r.choice(["alert", "dialog", "status"])) + hidden, body)

    def ad(self) -> str:
        r = self.rng
        tag = r.choice(["div", "div", "div", "aside", "section", "ins", "p", "span"])
        body = r.choice([self.phrase(), self.paragraph(), f'<a href="/buy">{self.paragraph()}</a>'])
        return ("<!-- ad -->" if self.chance(0.3) else "") + self.box(tag, self.named(AD_NAMES), body if tag in ("p", "span", "ins") or self.chance(0.5) else self.prose(2))

    def form(self) -> str:
        r = self.rng
        fields = "".join(r.choice([f"<label>{self.phrase()} <input name=a></label>", '<input type="text">', f"<select><option>{self.phrase()}<option>{self.phrase()}</select>", f"<textarea>{self.phrase()}</textarea>", f"<p>{self.phrase()}</p>"]) for _ in range(r.randint(1, 4)))
        head = r.choice(["", f"<h3>{self.phrase()}</h3>", f"<p>{self.paragraph()}</p>", self.paragraph()])
        return self.box("form", self.named(FORM_NAMES, "search", 0.4), f"{head}{fields}<button>{self.phrase()}</button>")

    def share(self) -> str:
        return self.box(self.rng.choice(["div", "ul", "p"]), self.named(SHARE_NAMES), self.links(self.rng.randint(1, 5)))

    def comments(self) -> str:
        r = self.rng
        tag = r.choice(["li", "div", "article", "p", "blockquote"])
        one = lambda: f"<{tag}{self.named(COMMENT_NAMES, p=0.6)}>" + (f"<span class=\"author\">{self.phrase()}</span> " if self.chance(0.4) else "") + (self.paragraph() if tag == "p" or self.chance(0.4) else self.prose()) + f"</{tag}>"
        rows = "".join(one() for _ in range(r.randint(1, 6)))
        rows = f"<ol>{rows}</ol>" if tag == "li" else rows
        head = f"<h{r.randint(2, 3)}>{self.phrase()}</h2>" if self.chance(0.6) else ""
        return self.box(r.choice(["div", "section", "section", "aside"]), self.named(COMMENT_NAMES), head + rows + (self.form() if self.chance(0.3) else ""))

    # --- the article ----------------------------------------------------------------------------------------------

    def part(self, depth: int = 0) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.62:
            form = r.random()
            if form < 0.12:
                return f"<p><b>{self.paragraph()}<br>"  # left open
            if form < 0.16:
                return f"<p>{self.paragraph()}"
            return f"<p{self.named(['lead', 'intro', 'text', 'byline', 'summary', 'first'], p=0.08)}>{self.paragraph()}</p>"
        if kind < 0.7:
            h = r.randint(2, 4)
            return f"<h{h}>{self.phrase()}</h{h}>"
        if kind < 0.78:
            t = r.choice(["ul", "ol"])
            link = self.chance(0.2)
            return f"<{t}>" + "".join(f"<li>{self.links(1) + ' ' if link else ''}{self.paragraph()}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if kind < 0.82:
            return f"<blockquote>{r.choice([self.paragraph(), '<p>' + self.paragraph() + '</p>'])}</blockquote>"
        if kind < 0.85:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.phrase()}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.88:
            return f"<figure><img src=a.png><figcaption>{self.paragraph()}</figcaption></figure>"
        if kind < 0.9:
            return f"<pre><code>{self.paragraph()}</code></pre>"
        if kind < 0.94:
            return f"{self.paragraph()}<br><br>{self.paragraph()}"
        if depth < 2:
            t = r.choice(["div", "section", "div"])
            return f"<{t}{self.named([*NEUTRAL_NAMES, 'section', 'chapter', 'body', 'paragraph'], p=0.5)}>" + "".join(self.part(depth + 1) for _ in range(r.randint(1, 4))) + f"</{t}>"
        return f"<p>{self.paragraph()}</p>"

    def article(self) -> str:
        r = self.rng
        n = r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20, 35])
        parts = [self.part() for _ in range(n)]
        if self.chance(0.35):
            for _ in range(r.randint(1, 3)):
                parts.insert(r.randint(0, len(parts)), getattr(self, r.choice(OFFERS))())
        if self.chance(0.15):
            parts.append(r.choice([self.comments, self.related, self.share])())
        title = f"<h1>{self.phrase() if self.chance(0.5) else self.paragraph()}</h1>"
        if self.chance(0.15):
            title = f"<header>{title}{'<p>' + self.paragraph() + '</p>' if self.chance(0.5) else ''}</header>"
        body = (title if self.chance(0.8) else "") + "".join(parts)
        kind = r.random()
        if kind < 0.4:
            return self.box("article", self.named(ARTICLE_NAMES, p=0.3), body, "1")
        if kind < 0.5:
            return self.box("main", self.named(ARTICLE_NAMES, p=0.3), body, "1")
        if kind < 0.56:
            return self.box("main", "", f"<article>{body}</article>", "1")
        if kind < 0.6:
            return self.box("div", ' role="main"', body, "1")
        if kind < 0.9:
            return self.box(r.choice(["div", "div", "section"]), self.named(ARTICLE_NAMES), body, "1")
        return self.box("div", self.named(NEUTRAL_NAMES, p=0.5), body, "1")

    def bare(self) -> str:
        """Nothing but an article, with or without tags of a page."""
        n = self.rng.randint(0, 5)
        body = "".join(self.part() for _ in range(n)) or "\n".join(self.paragraph() for _ in range(self.rng.randint(1, 3)))
        return f'<body {self.mark}="1">{body}'

    def page(self) -> str:
        r = self.rng
        if self.chance(0.04):
            return self.bare()
        before = [f() for f in (self.header, self.nav) if self.chance(0.55)]
        for f, p in ((self.notice, 0.25), (self.ad, 0.35), (self.side, 0.2), (self.form, 0.15), (self.share, 0.1)):
            if self.chance(p):
                before.insert(r.randint(0, len(before)), f())
        after = []
        for f, p in ((self.side, 0.25), (self.comments, 0.3), (self.related, 0.25), (self.ad, 0.2), (self.notice, 0.2), (self.form, 0.15), (self.nav, 0.15)):
            if self.chance(p):
                after.append(f())
        r.shuffle(after)
        if self.chance(0.7):
            after.append(self.footer())
        if self.chance(0.1):
            after.append(self.notice())
        article = self.article() if self.chance(0.96) else ""
        if self.chance(0.35):  # article and some surroundings share a column
            k, j = r.randint(0, len(before)), r.randint(0, len(after))
            wrap = r.choice([("<div{}>", "</div>"), ("<main{}>", "</main>"), ("<section{}>", "</section>"), ("<table><tr><td{}>", "</td></tr></table>")])
            middle = wrap[0].format(self.named(NEUTRAL_NAMES + ["main", "content", "primary"], p=0.7)) + "".join(before[k:]) + article + "".join(after[:j]) + wrap[1]
            body = "".join(before[:k]) + middle + "".join(after[j:])
        else:
            body = "".join(before) + article + "".join(after)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            body = f"<div{self.named(NEUTRAL_NAMES, p=0.8)}>{body}</div>"
        if self.chance(0.03):
            body = f"<form>{body}</form>"
        return f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><script>var a='<p>';</script></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")
