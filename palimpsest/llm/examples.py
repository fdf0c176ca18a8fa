"""The small labelled table of the text-block tree, as example pages.

The first character of each block is its label: ``+`` article, ``-`` not.
"""

import random

_LONG = "+The river rose for three days and the people of the lower town carried what they could to the hill above the mill, where they waited for the water to fall."
_MID = "+Nobody had seen anything like it before, not even the oldest of them."
_SHORT = "+It was cold."
_TINY = "+Yes."
_OPEN = "+A line without a stop"


def _nav(tag: str = "nav", more: str = "") -> str:
    return f"<{tag}{more}><ul><li><a href='/'>-Home</a></li><li><a href='/n'>-News today</a></li><li><a href='/s'>-Sport</a></li><li><a href='/w'>-Weather and travel</a></li></ul></{tag}>"


_BODY = f"<h1>+Flood in the lower town</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p><p>{_TINY}</p><p>{_OPEN}</p><p>{_LONG} {_MID[1:]}</p>"
_LIST = "<h2>+What to take along</h2><ul><li>+bread</li><li>+two warm coats</li><li>+a lamp and oil for a week.</li></ul><ol><li>+Close the doors.</li></ol><blockquote>+Leave nothing behind, she said.</blockquote><pre>+dam = 3</pre><table><tr><th>+Day</th><td>+4 m</td></tr></table>"
_AD = "-Buy two lamps now and get the third one free of charge today."
_LINKS = f"<p>{_LONG} <a href='/m'>mill</a></p><p>+See <a href='/r'>the report of the river board</a> for all figures.</p><p><a href='/x'>+The full list of names is here.</a></p>"
_FOOT = "<footer>&copy;- 2020 the town paper - all rights reserved and so on for ever.</footer>".replace("&copy;-", "-&copy;")


def _page(inner: str) -> str:
    return f"<!DOCTYPE html><html><head><title>none</title><style>p{{}}</style></head><body>{inner}</body></html>"


def labelled_pages() -> list[str]:
    cookie = "<div class='cookie-notice'><p>-We use cookies to make this site work better for you and for our partners, as set out at length in the policy that you can read on another page.</p></div>"
    comments = "<section id='comments'><h3>-Comments</h3><div class='comment'><p>-I remember the flood of the year before the war and it was far worse than this one, believe me, we had boats in the church.</p><p>-Nonsense!</p></div></section>"
    related = "<div class='related'><h4>-More stories</h4><ul><li><a href='/1'>-The mill is sold</a></li><li><a href='/2'>-A bridge for the hill, at last, after forty years of talk</a></li></ul></div>"
    side = "<aside><h3>-Most read</h3><p>-The mayor explains why the dam was not built in time and what it would have cost the town.</p><p><a href='/9'>-Read on</a></p></aside>"
    form = "<form action='/s'><label>-Your name please</label><p>-Sign up to get a letter from us every week, free of charge and without any strings attached.</p></form>"
    share = "<ul class='social share'><li><a href='/f'>-Share</a></li><li><a href='/t'>-Tell a friend</a></li></ul>"
    header = "<header><p>-The Town Paper</p><p>-News from the valley since the year of the great fire, every morning but Sunday.</p></header>"
    written = [
        _page(f"{_nav()}<div class='ad'>{_AD}</div><article>{_BODY}</article>{_FOOT}"),
        _page(f"{header}{_nav()}<main>{_BODY}{_LIST}</main>{side}{_FOOT}"),
        _page(f"{cookie}{_nav('div', ' class=menu')}<article>{_BODY}{share}{_LINKS}<div class='advert'>{_AD}</div>{_LIST}{comments}</article>{related}{_FOOT}"),
        _page(f"{header}<article><header><h1>+Flood</h1></header>{_BODY}<aside><p>-{_LONG[1:]}</p></aside><footer>-By our own reporter, with the help of many.</footer></article>{comments}{_FOOT}"),
        _page(f"<div id='header'><p>-The Town Paper</p></div>{_nav('ul', ' id=nav')}<div id='content'>{_BODY}{_LINKS}{_LIST}</div><div id='sidebar'><p>-{_LONG[1:]}</p></div>{related}<div id='footer'>-All rights reserved by the paper and its owners.</div>"),
        _page(f"<div class='post'>{_BODY}<p>{_LONG}</p></div>{comments}<div><a href='/a'>-About</a> <a href='/b'>-Contact</a></div>"),
        _page(f"{_nav()}<article>{_LINKS}<p>{_SHORT}</p><p>{_OPEN}</p></article><div>-{_MID[1:]}</div><div><p>-{_LONG[1:]}</p></div>{form}{_FOOT}"),
        _page(f"{form}{side}<main><article><p>{_TINY}</p></article>{_nav()}</main><p>-{_MID[1:]}</p>"),
        _page(f"{cookie}<table><tr><td><a href='/'>-Start</a></td><td><a href='/l'>-All the letters to the editor</a></td></tr></table><h1>+Flood</h1><p>{_LONG}</p><p>{_MID}</p><p>{_SHORT}</p><p>{_LONG}</p><div class='pager'><a href='/2'>-Next page</a></div>"),
        _page(f"<p>{_LONG}</p><p>{_TINY}</p><p>{_MID}</p>"),
        _page(f"<p>{_MID}</p>"),
        _page(f"<article>{_BODY}<p>{_TINY}</p></article>"),
        _page(f"{_nav()}<main>{_LINKS}<p>{_OPEN}</p></main>"),
        _page(f"{_nav()}<article><p>{_TINY}</p></article>"),
        _page(f"<article><p>{_SHORT}</p><p><a href='/k'>+Read it here</a></p></article><p>-{_LONG[1:]}</p>"),
        _page(f"<div>-{_SHORT[1:]}</div><article>{_LINKS}<ul><li><a href='/q'>+Quay</a></li><li><a href='/p'>+Old port</a></li></ul><p>{_OPEN}</p></article><div>-{_TINY[1:]}</div>"),
        _page(f"<section class='alert banner'><p>-{_LONG[1:]}</p><p>-{_SHORT[1:]}</p></section><div role='navigation'><p>-{_MID[1:]}</p></div><article><h2>+Later</h2><p>{_MID}</p><p>{_LONG}</p><div class='newsletter-signup'><p>-{_LONG[1:]}</p></div><p>{_OPEN}</p></article>{share}"),
    ]
    return written + _drawn(240)


def _drawn(pages: int, seed: int = 4) -> list[str]:
    """Pages by rule: bodies in marked, named, misnamed and bare containers, among parts with and without telling names, with words drawn at random."""
    r = random.Random(seed)
    stems = "river mill flood hill lamp bridge water town boat dam rain harvest letter church field stone winter road garden horse".split()

    def say(low: int, high: int, mark: str, stop: str = "") -> str:
        told = " ".join(r.choice(stems) for _ in range(r.randint(low, high)))
        return mark + told.capitalize() + stop

    def link(mark: str, low: int = 1, high: int = 4) -> str:
        return f"<a href='/{r.randrange(99)}'>{say(low, high, mark)}</a>"

    def links(tag: str, attributes: str = "") -> str:
        one, each = r.choice([("ul", "li"), ("div", "div"), ("div", "span"), ("div", "p")])
        rows = [link("-", 1, 7 if r.random() < 0.3 else 3) for _ in range(r.randint(2, 8))]
        told = "".join(f"<{each}>{x}</{each}>" for x in rows) if each != "span" else "-" + " | ".join(x.replace("-", "", 1) for x in rows)
        title = f"<h3>{say(1, 3, '-')}</h3>" if r.random() < 0.3 else ""
        return f"<{tag}{attributes}>{title}<{one}>{told}</{one}></{tag}>"

    def told(names: list[str], low: int, high: int) -> str:
        tag, name = r.choice(["div", "section", "div", "p"]), r.choice(names)
        inner = say(low, high, "-", ".") if tag == "p" or r.random() < 0.5 else f"<h3>{say(1, 3, '-')}</h3><p>{say(low, high, '-', '.')}</p>"
        return f"<{tag} {r.choice(['class', 'id'])}='{name}'>{inner}</{tag}>"

    def aside() -> str:
        return r.choice([
            lambda: links("nav"),
            lambda: links(r.choice(["div", "ul"]), f" class='{r.choice(['nav', 'menu', 'top-menu', 'social', 'related', 'pager', 'sidebar', 'tags'])}'"),
            lambda: links("div"),
            lambda: told(["ad", "advert", "ad-banner", "promo", "sponsored"], 3, 60),
            lambda: told(["cookie-notice", "cookies", "newsletter", "newsletter-signup", "notice", "gdpr-banner", "popup"], 8, 70),
            lambda: f"<aside><h3>{say(1, 3, '-')}</h3><p>{say(5, 70, '-', '.')}</p></aside>",
            lambda: f"<form action='/s'><label>{say(1, 4, '-')}</label><p>{say(3, 60, '-', '.')}</p></form>",
            lambda: f"<header><p>{say(1, 4, '-')}</p><p>{say(3, 60, '-', '.')}</p></header>",
        ])()

    def comments() -> str:
        said = [say(2, 80, "-", r.choice(".!?")) for _ in range(r.randint(1, 4))]
        tag, name = r.choice([("div", "comment"), ("article", "comment"), ("li", "reply"), ("p", "comment-text")])
        return f"<section {r.choice(['id', 'class'])}='{r.choice(['comments', 'comment-list', 'replies', 'discussion'])}'><h3>{say(1, 3, '-')}</h3>" + "".join(f"<{tag} class='{name}'>{x}</{tag}>" for x in said) + "</section>"

    def body(marked: bool) -> str:
        parts = [f"<h1>{say(2, 10, '+')}</h1>"]
        for _ in range(r.randint(2, 9)):
            parts.append(r.choice([
                lambda: f"<p>{say(12, 70, '+', '.')}</p>",
                lambda: f"<p>{say(12, 70, '+', '.')}</p>",
                lambda: f"<p>{say(1 if marked else 6, 12, '+', r.choice(['.', '!', '']))}</p>",
                lambda: f"<p>{say(10, 30, '+')} {link('')} {say(5, 20, '')}.</p>",
                lambda: f"<h2>{say(1, 6, '+')}</h2><p>{say(8, 50, '+', '.')}</p>",
                lambda: "<ul>" + "".join(f"<li>{say(1 if marked else 5, 12, '+')}</li>" for _ in range(r.randint(2, 5))) + "</ul>" + f"<p>{say(8, 40, '+', '.')}</p>",
                lambda: f"<blockquote>{say(5, 40, '+', '.')}</blockquote>",
                lambda: (f"<p>{link('+', 1, 6)}</p>" if marked else "") + f"<p>{say(8, 50, '+', '.')}</p>",
                lambda: (f"<div class='{r.choice(['ad', 'advert', 'share', 'newsletter'])}'>{say(2, 25, '-')}</div>" if marked else "") + f"<p>{say(8, 50, '+', '.')}</p>",
                lambda: f"<div class='{r.choice(['side-note-on-search', 'more-on-rain', 'the-form-of-water'])}'><p>{say(12, 50, '+', '.')}</p></div>",
            ])())
        return "".join(parts)

    wrappers = ["<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<div class='search-results-explained'><article>%s</article></div>", "<section class='ad-hoc-notes'><main>%s</main></section>", "<article><header>%s</header></article>"]
    plain = ["<div class='c1'>%s</div>", "<div id='more-about-water'>%s</div>", "<table><tr><td>%s</td></tr></table>", "<div class='story-and-comment-on-it'>%s</div>", "%s", "<div class='post'>%s</div>"]
    footers = [_FOOT, "<footer>%s</footer>", "<div id='footer'>%s</div>", "<div>%s</div>"]
    out = []
    for _ in range(pages):
        marked = r.random() < 0.6
        footer = r.choice(footers)
        before, after = ["".join(aside() for _ in range(r.randint(0, 3))) for _ in range(2)]
        if r.random() < 0.4:
            after = comments() + after
        whole = r.choice(wrappers if marked else plain) % body(marked)
        if "%s" in footer:
            strip = r.random() < 0.5
            footer = footer % ("-" + link("") + " " + link("") if strip or footer == "<div>%s</div>" else say(3, 60, "-"))
        out.append(_page(before + whole + after + footer))
    return out
