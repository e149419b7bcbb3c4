"""Pages with names that the extractor doesn't list, nested cards, comments of common themes, links as content; and letters of scripts."""

import random

import pytest

from kinloom.llm import html, language

LONG = "A paragraph that is long enough to be the text of a page, with several words in it and some more."
MORE = "Another one follows it, about as long as the first, so that there is a text to speak of here too."
CARD = "A teaser of some other story, which is long enough to look like text of its own, but isn't."


def test_articles_in_skipped_elements_stay_skipped():
    comments = f"<ol class='commentlist'><li><article class='comment-body'><p>{CARD}</p></article></li><li><article class='comment-body'><p>{CARD}</p></article></li></ol>"
    assert html.main_text(f"<main><article><p>{LONG}</p><p>{MORE}</p></article>{comments}</main>") == f"{LONG}\n{MORE}"
    assert html.main_text(f"<article><p>{LONG}</p><p>{MORE}</p>{comments}</article>") == f"{LONG}\n{MORE}"
    side = f"<aside><article class='card'><p>{CARD}</p></article><article class='card'><h3>{CARD}</h3></article></aside>"
    assert html.main_text(f"{side}<main><p>{LONG}</p><p>{MORE}</p></main>{side}") == f"{LONG}\n{MORE}"
    assert html.main_text(f"<article><p>{LONG}</p><p>{MORE}</p><div class='xq'><article><p>{CARD}</p></article></div></article>") == f"{LONG}\n{MORE}"


def test_open_elements_dont_swallow_the_page():
    assert html.main_text(f"<nav><ul><li><a>One</a></li></ul><main><p>{LONG}</p></main>") == LONG
    assert html.main_text(f"<div class='page'><div class='ad'><p>{CARD}</div><article><p>{LONG}</p></article></div>") == LONG


def test_links_as_content_stay():
    refs = ["One book about rivers", "Another about mills", "A third about bread", "A fourth"]
    items = "".join(f"<li><a href='#'>{r}</a></li>" for r in refs)
    assert html.main_text(f"<article><p>{LONG}</p><h2>References</h2><ul>{items}</ul></article>") == "\n".join([LONG, "References", *refs])
    assert html.main_text(f"<article><p>{LONG}</p><p>See also:</p><ol>{items}</ol><p>{MORE}</p></article>") == "\n".join([LONG, "See also:", *refs, MORE])


@pytest.mark.parametrize("name", ["comment", "sidebar", "ad", "newsletter", "menu", "comments-area", "footer"])
def test_no_name_empties_a_page(name):
    for page in (f"<div class='{name}'><p>{LONG}</p><p>{MORE}</p></div>", f"<main class='{name}'><p>{LONG}</p><p>{MORE}</p></main>",
                 f"<div id='{name}'><article><p>{LONG}</p><p>{MORE}</p></article></div>"):
        assert html.main_text(page) == f"{LONG}\n{MORE}"
    whole = f"<div class='{name}'><main><h1>{MORE}</h1><p>{LONG}</p></main></div><div class='comments'><p>{CARD}</p></div>"
    assert html.main_text(whole) == f"{MORE}\n{LONG}"


def test_compound_names_leave_text():
    assert html.main_text(f"<article><p class='lead-ad'>{LONG}</p><p>{MORE}</p></article>") == f"{LONG}\n{MORE}"
    assert html.main_text(f"<article><p>{MORE}</p><div class='news-menu'><p>{LONG}</p></div></article>") == f"{MORE}\n{LONG}"
    links = "".join(f"<li><a href='#'>{w}</a></li>" for w in ("Home", "News", "Sport", "About"))
    assert html.main_text(f"<article><p>{MORE}</p><div class='zeta-menu'><ul>{links}</ul></div><p>{LONG}</p></article>") == f"{MORE}\n{LONG}"
    assert html.main_text(f"<article><p>{MORE}</p><div class='top-ad'><p>{CARD}</p></div><p>{LONG}</p></article>") == f"{MORE}\n{LONG}"
    assert html.main_text(f"<form action='/'><div><p>{LONG}</p><p>{MORE}</p></div></form>") == f"{LONG}\n{MORE}"


def page_of_strange_names(seed):
    """An article whose boxes, and those of what isn't text, are called by random syllables; roles come from elements and link density."""
    rng = random.Random(seed)
    name = lambda: "-".join("".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(1, 2)))
    words = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."
    menu = lambda: f"<ul class='{name()}'>" + "".join(f"<li class='{name()}'><a href='#'>{words(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(3, 9))) + "</ul>"
    want, body = [words(6)], []
    body.append(f"<h1 class='{name()}'>{want[0]}</h1>")
    for k in range(rng.randint(3, 10)):
        t = words(rng.randint(14, 70) if k < 2 else rng.choice((4, 12, 40)))
        want.append(t)
        kind = rng.choice(("p", "p", "p", "blockquote", "h2", "div"))
        body.append(f"<{kind} class='{name()}'>{t}</{kind}>")
        if k and kind != "h2" and rng.random() < 0.3:
            body.append(rng.choice((lambda: f"<nav class='{name()}'>{menu()}</nav>", lambda: f"<aside id='{name()}'><p>{words(25)}</p></aside>", menu,
                                    lambda: f"<script>{words(9)}</script>", lambda: f"<form class='{name()}'><p>{words(3)}</p><input></form>"))())
    last = words(30)
    body.append(f"<p>{last}</p>")
    want.append(last)
    inner = f"<div class='{name()}'>{''.join(body)}</div>"
    frame = rng.choice(("<article class='%s'>", "<main id='%s'>", "<main><article class='%s'>")) % name()
    close = {"<a": "</article>", "<m": "</main>"}[frame[:2]] if "><" not in frame else "</article></main>"
    around = [f"<header class='{name()}'><p>{words(3)}</p>{menu()}</header>", f"<div class='{name()}'>{menu()}</div>", frame + inner + close,
              f"<div class='{name()}'><p>{words(20)}</p>{menu()}</div>", f"<footer>{words(8)}</footer>"]
    return f"<html><body class='{name()}'>{''.join(around)}</body></html>", "\n".join(want)


def test_names_that_no_list_has():
    pages = [page_of_strange_names(k) for k in range(400)]
    right = sum(html.main_text(raw) == want for raw, want in pages)
    assert right >= 0.95 * len(pages)


def test_letters():
    for t in ("½ ² ⅷ", "①②", "12 34", "̈ ̈"):
        assert language.words(t) == []
    assert language.words("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert language.words("x² Å a_b") == ["x", "å", "a", "b"]


def test_number_signs_are_und(spark):
    rows = [(i, "the cat and the dog went over the hill with us", "en") for i in range(40)] + [(100, "½", None), (101, "² ⅷ", "en"), (102, "the cat", None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[100] == got[101] == "und" and got[102] == "en"
