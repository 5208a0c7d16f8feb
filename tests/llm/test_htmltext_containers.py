"""Class names and forms do not take the article away."""

import pytest

from monthloom.llm import htmltext as H

LONG = "The water of the river was high and the people of the town had to leave it by the old road to the hills in the east."
OTHER = "This is what the others in the town have said of it and not a part of the article that was on the page at first."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article><div class='sidebar'>{OTHER}</div></div>", LONG),
        (f"<main class='no-sidebar'><p>{LONG}</p></main>", LONG),
        (f"<article class='post comment-status-open'><p>{LONG}</p></article><div class='comments'><p>{OTHER}</p><p>{OTHER}</p></div>", LONG),
        (f"<main><h1>Head</h1><article class='post comment-status-open'><p>{LONG}</p></article></main>", f"Head\n{LONG}"),
        (f"<form id='aspnetForm'><nav>x</nav><div><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{OTHER}</p></div></form>", f"{LONG}\n{LONG}"),
        (f"<form><main><p>{LONG}</p></main></form>", LONG),
        (f"<div class='content-sidebar-wrap'><p>{LONG}</p><p>{LONG}</p><div class='related'><p>{OTHER}</p></div></div>", f"{LONG}\n{LONG}"),
        ("<div class='search-page'><article>Short.</article></div>", "Short."),
        ("<article><h1><a href='/a'>Title</a></h1><ul><li><a href='/b'>Item</a></li></ul><p>" + LONG + "</p></article>", f"Title\nItem\n{LONG}"),
        # and what is something else stays out
        (f"<article><p>{LONG}</p><div class='comments'><article class='comment'><p>{OTHER}</p><p>{OTHER}</p></article></div></article>", LONG),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='related'><article><p>{OTHER}</p></article></div>", f"{LONG}\n{LONG}"),
        (f"<p>{LONG}</p><section class='comments'><p>{OTHER}</p><p>{OTHER}</p></section>", LONG),
        (f"<article><p>{LONG}</p><form><p>Your name</p></form></article>", LONG),
        ("<div class='sidebar'><p>x</p></div>", ""),
    ],
)
def test_containers(body, text):
    assert H.main_text(f"<html><body>{body}</body></html>") == text
