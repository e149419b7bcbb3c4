"""Generated pages with a known main text, and pages that take long to read carelessly."""

import random
import time

import pytest

from kinloom.llm import html

WORDS = "the river runs past old mills and new houses while people walk along its banks talking of rain and bread".split()
UNLUCKY = ("long form", "post-search-results", "widget-free-zone form", "article share", "banner-story", "legal notice", "related", "no-sidebar login-story form", "content", "post")


def page(seed):
    """``(html, text)``: an article in one of several frames, with what doesn't belong to it in between and around."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    link = lambda n: f"<a href='/x{rng.randrange(99)}'>{words(n)}</a>"
    menu = lambda: "<ul>" + "".join(f"<li>{link(2)}</li>" for _ in range(rng.randint(3, 8))) + "</ul>"
    between = [
        lambda: f"<div class='ad'>{words(rng.randint(2, 30))}</div>", lambda: f"<aside><p>{words(20)}</p></aside>", lambda: f"<div class='cookie-notice'>{words(8)}</div>",
        lambda: f"<form><label>{words(3)}</label><input name=q><button>Go</button></form>", lambda: f"<nav>{menu()}</nav>", menu, lambda: f"<script>var a = '<p>{words(5)}</p>';</script>",
        lambda: f"<div class=\"newsletter-signup box\"><h4>{words(2)}</h4><p>{words(12)}</p></div>", lambda: "<!-- <p>not this</p> -->", lambda: f"<div class='share-buttons'>{link(1)}</div>"]
    out, want = [f"<h1>{(title := words(5))}</h1>"], [title]
    for k in range(rng.randint(4, 9)):
        kind = rng.random()
        n = rng.randint(12, 60) if k < 2 else rng.choice((3, 9, 30))
        if kind < 0.6 or k < 2:
            a, b = words(n), words(3)
            out.append(f"<p>{a}\n   <b>{b}</b>&nbsp;&amp; more</p>" if rng.random() < 0.5 else f"<p>{a} {b}&nbsp;&amp; more")
            want.append(f"{a} {b} & more")
        elif kind < 0.7:
            x = words(4)
            out.append(f"<p><a href='#'>{x}</a></p>")
            want.append(x)
        elif kind < 0.8:
            x, y = words(4), words(6)
            out.append(f"<ul><li>{x}</li><li>{y}</li></ul>")
            want += [x, y]
        elif kind < 0.9:
            x, y = words(3), words(5)
            out.append(f"<table><tr><td>{x}</td><td>{y}</td></tr></table>")
            want.append(f"{x} {y}")
        else:
            x = words(8)
            out.append(f"<blockquote>{x}</blockquote>")
            want.append(x)
        if rng.random() < 0.5 and 0 < k:
            out.append(rng.choice(between)())
    # a closing paragraph after an advert
    last = words(10) + " " + words(8)
    out += [between[0](), f"<p>{last}</p>"]
    want.append(last)
    body = "".join(out)
    frame = rng.choice(("<article>%s</article>", "<main>%s</main>", "<main><div class='{0}'>%s</div></main>", "<div id='{0}'>%s</div>", "<div class='page'><div class='{0}'>%s</div></div>"))
    body = frame.replace("{0}", rng.choice(UNLUCKY)) % body
    comments = "".join(f"<div class='comment'><p>{words(rng.randint(5, 60))}</p></div>" for _ in range(rng.randint(0, 12)))
    side = f"<div id='sidebar' class='side left'><h3>{words(2)}</h3><p>{words(25)}</p>{menu()}</div>"
    head = f"<header><div class='logo'>{words(3)}</div><nav>{menu()}</nav></header>"
    foot = f"<footer><p>&copy; {words(6)}</p>{menu()}</footer>"
    parts = [head, side if rng.random() < 0.5 else "", body, side if rng.random() < 0.5 else "", f"<section id='comments'>{comments}</section>", foot]
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body class='has-sidebar'>{''.join(parts)}<script>x()</script></body></html>", "\n".join(want)


@pytest.mark.parametrize("seed", range(60))
def test_main_text_is_exact(seed):
    raw, want = page(seed)
    assert html.main_text(raw) == want


def test_containers_with_unlucky_names():
    text = "A paragraph that is long enough to be the text of a page, with several words in it."
    for c in UNLUCKY:
        assert html.main_text(f"<main><div class='{c}'><p>{text}</p></div></main>") == text
        assert html.main_text(f"<div class='{c}'><p>{text}</p></div>") == text
    assert html.main_text(f"<article><p>{text}</p><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></article>") == text
    assert html.main_text(f"<article><p>{text}</p><div class='related-posts'><p>Other things to read</p></div></article>") == text
    assert html.main_text(f"<article><p>{text}</p></article><div class='comments-area'>{'<p>' + text + '</p>'}</div>" * 1) == text


@pytest.mark.parametrize("part", ["<object>", "<svg x", "<head>", "<svg><p>a", "<!--", "<script", "<a \"", "<a '>", "<div class=form>", "<div class=form>x", "</p", "<template><title"])
def test_hostile_pages_take_time_in_proportion(part):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html.main_text(part * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
