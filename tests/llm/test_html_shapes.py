"""Main text of pages of many shapes: boilerplate by name however long, articles that are teasers, pages without elements for text."""

import random

import pytest

from fathomline.llm.html_text import main_text


def words(n, w="word"):
    return " ".join(f"{w}{k}" for k in range(n))


P100 = words(100, "text")
ARTICLE = f"<article><h1>A title</h1><p>{P100}</p></article>"
MAIN = f"A title\n{P100}"


@pytest.mark.parametrize("n", [5, 30, 100, 300, 1000, 3000])
@pytest.mark.parametrize("page", [
    "<body>{a}<div id=\"comments\"><p>{c}</p></div></body>", "<main>{a}<div class='comment-list'><div><p>{c}</p><p>{c}</p></div></div></main>",
    "<body><div class=wrap>{a}<section class='comments'><h2>Comments</h2><p>{c}</p></section></div></body>", "<div class='cookie-consent'><p>{c}</p></div>{a}",
    "{a}<div class=sidebar><p>{c}</p><p>{c}</p></div>", "<div id=comments><p>{c}</p></div>{a}",
])
def test_named_boilerplate_goes_however_long(page, n):
    assert main_text(page.format(a=ARTICLE, c=words(n, "reader"))) == MAIN
    plain = f"<div class=content><h1>A title</h1><p>{P100}</p></div>"
    assert main_text(page.format(a=plain, c=words(n, "reader"))) == MAIN


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_comments_inside_the_article(n):
    for tag in ("section", "div"):
        page = f"<article><h1>A title</h1><p>{P100}</p><{tag} class='comments'><p>{words(n, 'reader')}</p></{tag}></article>"
        assert main_text(page) == MAIN
    page = f"<article><h1>A title</h1><p>{P100}</p><div><article><p>{words(n, 'reader')}</p></article></div></article>"
    assert main_text(page) == MAIN


@pytest.mark.parametrize("short", [12, 30, 60])
def test_short_texts_beside_long_notices(short):
    for name in ("cookie-consent", "sidebar", "newsletter-signup", "related-posts"):
        page = f"<body><div class='{name}'><p>{words(200, 'notice')}</p></div><div class=text><p>{words(short)}</p></div></body>"
        assert main_text(page) == words(short), name


def test_all_blocks_of_a_text_without_an_article():
    a, b = words(80, "a"), words(60, "b")
    page = f"""<html><body><div class=menu><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div class=content><h1>Two words</h1><p>{a}</p><h2>Part</h2><p>Short one.</p>
      <ul><li>First thing</li><li>second</li></ul><p>{b}</p></div><div class=footer>All rights reserved</div></body></html>"""
    assert main_text(page) == "\n".join(["Two words", a, "Part", "Short one.", "First thing", "second", b])
    page = f"<body><h1>Two words</h1><div class=ad><p>Buy it now</p></div><p>{a}</p><p>Short.</p><p>{b}</p><p>The end.</p><p><a href=/x>Next page</a></p></body>"
    assert main_text(page) == "\n".join(["Two words", a, "Short.", b, "The end."])


def test_teasers_are_no_article():
    text = "\n".join([words(150, "a"), words(150, "b")])
    cards = "".join(f"<article><h3><a href=/{k}>Teaser {k}</a></h3><p>{words(14, f't{k}')}</p></article>" for k in range(3))
    for page in (f"<div class=story><h1>Head</h1><p>{words(150, 'a')}</p><p>{words(150, 'b')}</p></div><div>{cards}</div>", f"<div>{cards}</div><div class=story><h1>Head</h1><p>{words(150, 'a')}</p><p>{words(150, 'b')}</p></div>"):
        assert main_text(page) == "Head\n" + text


def test_wrappers_named_after_what_stands_beside():
    for name in ("page-with-sidebar", "sidebar-layout", "widget-area", "comments-page"):
        page = f"<div class='{name}'>{ARTICLE}<div class='comments'><p>{words(400, 'reader')}</p></div></div>"
        assert main_text(page) == MAIN, name
        plain = f"<body><nav><a href=/>Home</a></nav><div class='{name}'><div><h1>A title</h1><p>{P100}</p></div><div class='comments'><p>{words(400, 'reader')}</p></div></div></body>"
        assert main_text(plain) == MAIN, name
    both = f"<div class='widget-content'>{ARTICLE}</div><div class='widget comments'><p>{words(400, 'reader')}</p></div>"
    assert main_text(both) == MAIN


def test_formulas_are_text():
    page = f"<article><p>{P100} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><text>no</text></svg></article>"
    assert main_text(page) == f"{P100} x=2 holds"


def labelled_page(rng):
    """A page and its blocks with whether they are the text: a shape of containers drawn at random."""
    blocks = []

    def say(n, main, w):
        blocks.append((words(n, f"{w}{len(blocks)}x"), main))
        return blocks[-1][0]

    link = lambda: f"<li><a href=/>{say(rng.randint(1, 4), False, 'l')}</a></li>"
    nav = lambda: f"<{(t := rng.choice(['nav', 'div class=menu', 'div']))}><ul>{''.join(link() for _ in range(rng.randint(3, 8)))}</ul></{t.split()[0]}>"
    side = lambda: f"<{(t := rng.choice(['aside', 'div class=sidebar', 'section id=related', 'div class=\"newsletter box\"']))}>{''.join(f'<p>{say(rng.randint(3, 80), False, chr(115))}</p>' for _ in range(rng.randint(1, 4)))}</{t.split()[0]}>"
    reader = lambda: f"<div id=comments>{''.join(f'<div class=c><p>{say(rng.randint(2, 200), False, chr(114))}</p></div>' for _ in range(rng.randint(1, 6)))}</div>"
    foot = lambda: f"<{(t := rng.choice(['footer', 'div class=footer', 'div class=copyright']))}>{say(rng.randint(3, 20), False, 'f')}</{t.split()[0]}>"

    def text():
        parts = [f"<h1>{say(rng.randint(1, 8), True, 'h')}</h1>", f"<p>{say(rng.randint(30, 120), True, 'p')}</p>"]
        for _ in range(rng.randint(1, 6)):
            match rng.randrange(5):
                case 0:
                    parts.append(f"<h2>{say(rng.randint(1, 5), True, 'h')}</h2>")
                case 1:
                    parts.append(f"<ul>{''.join(f'<li>{say(rng.randint(1, 12), True, chr(105))}</li>' for _ in range(rng.randint(1, 4)))}</ul>")
                case 2:
                    parts.append(f"<p>{say(rng.randint(1, 6), True, 'q')}</p>")
                case _:
                    parts.append(f"<p>{say(rng.randint(12, 150), True, 'p')}</p>")
        parts.append(f"<p>{say(rng.randint(25, 90), True, 'p')}</p>")
        box = rng.choice(["article", "main", "div class=content", "div", "section class=post"])
        return f"<{box}>{''.join(parts)}</{box.split()[0]}>"

    page = rng.choice([lambda: nav() + text() + side() + foot(), lambda: nav() + text() + reader() + foot(), lambda: side() + text() + reader(), lambda: nav() + "<div class=page>" + text() + side() + reader() + "</div>" + foot(), lambda: text() + nav() + foot(), lambda: "<div class='ad'>" + say(5, False, "a") + "</div>" + text() + reader() + nav()])()
    return f"<html><body>{page}</body></html>", blocks


def test_precision_and_recall_over_pages_of_many_shapes():
    rng = random.Random(4)
    right = kept = main = 0
    for _ in range(300):
        page, blocks = labelled_page(rng)
        got = set(main_text(page).split("\n"))
        kept += len(got)
        main += sum(m for _, m in blocks)
        right += sum(m and b in got for b, m in blocks)
    assert right / kept >= 0.97 and right / main >= 0.97, (right / kept, right / main)


def test_long_and_deep_pages_take_linear_time():
    import time

    def took(page):
        start = time.perf_counter()
        main_text(page)
        return time.perf_counter() - start

    for make in (lambda n: "<div>" * n + f"<p>{P100}</p>" * 20, lambda n: "<div class=comments>" * n + f"<p>{P100}</p>", lambda n: f"<div><p>{words(12)}</p></div>" * n, lambda n: "<article>" * n + f"<p>{P100}</p>"):
        small, large = min(took(make(1000)) for _ in range(3)), took(make(8000))
        assert large < 40 * small + 0.5
