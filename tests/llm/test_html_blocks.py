"""Pages built from marked blocks: the text must be the marked ones, in page order."""

import random

import pytest

from cellwatch.llm import htmltext

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore".split()


def sentence(r, least=12, most=40):
    return (" ".join(r.choice(WORDS) for _ in range(r.randint(least, most))) + ", " + r.choice(WORDS) + ".").capitalize()


def paragraph(r):
    text = " ".join(sentence(r) for _ in range(r.randint(1, 4)))
    return f"<p>{text}</p>", [text]


def heading(r):
    text, level = " ".join(r.choice(WORDS) for _ in range(3)), r.randint(2, 4)
    return f"<h{level}>{text}</h{level}>", [text]


def listing(r):
    items = [sentence(r, 3, 8) for _ in range(r.randint(2, 4))]
    return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{t}>", items


def quotation(r):
    text = sentence(r)
    return f"<blockquote>{text}</blockquote>", [text]


def noise(r):
    """What is no part of an article: menus, notices, adverts, comments, forms, scripts."""
    text = sentence(r, 3, 30)
    return r.choice([
        f'<nav><a href="/">{text}</a></nav>', f'<div class="cookie-notice">{text}</div>', f'<div class="ad">{text}</div>',
        f'<aside>{text}</aside>', f'<div id="comments"><p>{text}</p></div>', f'<article class="comment"><p>{text}</p></article>',
        f'<article class="related-post"><p>{text}</p></article>', f"<script>var x = '<p>{text}</p>'</script>", f"<style>p {{}} {text}</style>",
        f"<form><p>{text}</p></form>", f"<!-- <p>{text}</p> -->", f'<section class="newsletter"><p>{text}</p></section>',
        f'<ul class="menu"><li><a href="/a">{text}</a></li></ul>', f'<div hidden><p>{text}</p></div>'])


def page(r, wrap):
    parts, want = [], []
    for make in [paragraph, *r.choices([paragraph, paragraph, heading, listing, quotation], k=r.randint(4, 9))]:
        html, lines = make(r)
        parts.append(html)
        want += lines
        if r.random() < 0.4:
            parts.append(noise(r))
    body = wrap.format("\n".join(parts))
    return f"<html><head><title>x</title></head><body><header>site</header>{noise(r)}{body}{noise(r)}<footer>f</footer></body></html>", want


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<article><div>{}</div></article>",
                                  '<main class="content"><article class="post">{}</article></main>'])
def test_text_is_that_of_the_marked_blocks(wrap):
    r = random.Random(wrap)
    for _ in range(60):
        html, want = page(r, wrap)
        assert htmltext.main_text(html).split("\n") == want


LONG = "A paragraph of some length, with commas, that anybody would call ordinary text of an article. " * 3


def test_headings_and_lists_beside_the_best_element():
    html = f"<body><h3>Part one</h3><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>first thing</li><li>second thing</li></ul></body>"
    assert htmltext.main_text(html).split("\n") == ["Part one", LONG.strip(), LONG.strip(), "first thing", "second thing"]


def test_a_weaker_division_beside_the_best_element():
    one = "One ordinary paragraph of its own."
    html = f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><p>{one}</p></div><div><a href=/>Elsewhere you can read this long list of links</a></div></body>"
    assert htmltext.main_text(html).split("\n") == [LONG.strip()] * 3 + [one]


@pytest.mark.parametrize("name", ["comment", "related-post", "comments"])
def test_articles_that_are_named_otherwise_go(name):
    inside = f'<article><p>{LONG}</p><article class="{name}"><p>{LONG[:90]}</p></article></article>'
    beside = f'<div><article><p>{LONG}</p></article><article class="{name}"><p>{LONG[:90]}</p></article></div>'
    assert htmltext.main_text(inside) == htmltext.main_text(beside) == LONG.strip()


def test_a_page_that_is_named_otherwise_as_a_whole_stays():
    assert htmltext.main_text(f'<main class="widget"><p>{LONG}</p></main>') == LONG.strip()


def test_ties_go_to_the_first():
    html = f'<div><section><p>{LONG}</p></section></div><table><tr><td><a href="/">{"link " * 40}</a></td></tr></table>'
    assert htmltext.main_text(html) == LONG.strip()
