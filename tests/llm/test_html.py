"""Main text of pages against what they were built from."""

import html
import random

import pytest

from weftline.llm.html_extraction import Page, _is_noise

PROSE = "The quick brown fox jumps over the lazy dog while the band plays on and nobody minds the noise at all. "
ARTICLE = f"<h1>Some heading</h1><p>{PROSE * 2}</p><p>{PROSE * 2}</p>"
TEXT = f"Some heading {(PROSE * 2).strip()} {(PROSE * 2).strip()}"
BOILERPLATE = [
    '<div class="user-comments"><p>{}</p></div>', '<div id="article-ad">{}</div>', '<section class="inline-advert"><p>{}</p></section>', "<aside><p>{}</p></aside>", "<form><label>{}</label><p>{}</p></form>",
    '<div class="cookie-consent">{}</div>', "<dialog open><p>{}</p></dialog>", "<nav><ul><li><a href=x>{}</a></li></ul></nav>", "<header><p>{}</p></header>", '<div class="site-sidebar">{}</div>', '<ul class="main-menu"><li>{}</li></ul>', "<fieldset>{}</fieldset>",
]


@pytest.mark.parametrize("page", [
    f"<body><form action=x><nav>menu</nav><div class=content>{ARTICLE}</div></form></body>", f"<body><form><article>{ARTICLE}</article></form></body>", f"<body><div class=header>top</div><form><header>site</header><main>{ARTICLE}</main></form></body>",
    f"<article><header><h1>Some heading</h1></header><p>{PROSE * 2}</p><p>{PROSE * 2}</p></article>", f"<main><article><div class=no-sidebar>{ARTICLE}</div></article></main>", f"<dialog><div>{ARTICLE}</div></dialog>",
    f"<body><aside><p>beside</p></aside><article>{ARTICLE}</article><div class=user-comments><p>{PROSE * 4}</p></div></body>",
])
def test_main_text_stays(page):
    assert Page(page).text(None) == TEXT


def test_boilerplate_goes_wherever_it_stands():
    r = random.Random(3)
    words = lambda n: " ".join(r.choices(["alpha", "béta", "g&mma", "<del>", "épsilon"], k=n))
    for k in range(150):
        blocks = [words(r.randrange(8, 60)) for _ in range(r.randrange(3, 9))]
        parts = [f"<{t}>{html.escape(b)}</{t}>" for b, t in zip(blocks, r.choices(["p", "p", "h2", "blockquote", "li", "pre"], k=len(blocks)), strict=True)]
        for noise in r.sample(BOILERPLATE, r.randrange(1, 6)):
            at = r.choice([0, len(parts)]) if "<header" in noise else r.randrange(len(parts) + 1)
            if "<header" not in noise:  # the header of an article is part of it
                parts.insert(at, noise.replace("{}", html.escape(words(r.randrange(2, 9)))))
        around = ["".join(x.replace("{}", "outside " * r.randrange(1, 5)) for x in r.sample(BOILERPLATE, 3)) for _ in range(2)]
        frame = r.choice(["<main>{}</main>", "<article>{}</article>", "<div class=page><article>{}</article></div>", "<form><main><article>{}</article></main></form>"])
        page = f"<!doctype html><html><body>{around[0]}{frame.replace('{}', ''.join(parts))}{around[1]}</body></html>"
        assert Page(page).text(None) == " ".join(" ".join(b.split()) for b in blocks), (k, page)


def test_names_of_boilerplate():
    assert all(map(_is_noise, ["comments", "user-comments", "article_ad", "inline-advert", "site-header", "sidebar-left", "post-share"]))
    assert not any(map(_is_noise, ["no-sidebar", "has-toc", "with-comments", "article-header", "popular-science", "content", "adjacent", "download"]))
