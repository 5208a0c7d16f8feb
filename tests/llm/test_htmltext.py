import pytest

from monthloom.llm import htmltext as H
from monthloom.llm.queries import op9

LONG = "The water of the river was high and the people of the town had to leave it by the old road to the hills in the east."


def page(body, head="<title>Not this</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>Short.</p><p><b>Open <br><p>Next\n\t one</article><footer>&copy; x</footer>", "A & B\nShort.\nOpen\nNext one"),
        (f"<div class='ad-banner'>{LONG}</div><article><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form></article>", LONG),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article>", f"Title\n{LONG}"),
        (f"<header><p>{LONG}</p></header><div id='cookie-notice'><p>{LONG}</p></div><div><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>", f"Head\n{LONG}\nYes.\n{LONG}"),
        (f"<main><p>a &lt;b&gt; &#233; &eacute;&nbsp;x</p><!-- <p>no</p> --><p>{LONG}</p><div hidden>no</div></main>", f"a <b> é é x\n{LONG}"),
        (f"<p>{LONG}</p><ul><li><a href='a'>{LONG}</a></li><li><a href='b'>{LONG}</a></li></ul>", LONG),
        ("<nav>only a menu</nav><footer>and a footer</footer>", ""),
        (f"<article><p>{LONG}<p>5 < 6 and 7 > 3<div>{LONG}</div>", f"{LONG}\n5 < 6 and 7 > 3\n{LONG}"),
        (f"<article><p>{LONG}</p><pre>x  y</pre><p title='a>b'>z</p><p>cut <a href=\"unclosed", f"{LONG}\nx y\nz\ncut"),
        (f"<article><p>one<br>two</p><p>a<br><br>b</p><ul><li>i<li>j</ul><table><tr><td>c<td>d</table><p>{LONG}</article>", f"one two\na\nb\ni\nj\nc\nd\n{LONG}"),
    ],
)
def test_pages(body, text):
    assert H.main_text(page(body)) == text


def test_second_pass():
    def run(labels, main=(), out=(), heading=()):
        return H.second_pass(labels, [H._Block(i in main, i in out, i in heading) for i in range(len(labels))])

    assert run([1, -1, 1]) == [1, 1, 1]
    assert run([0, -1, 0]) == [0, 0, 0]
    assert run([1, -1, -1, -1, 0]) == [1, 1, 0, 0, 0]
    assert run([1, -1, 0], out=[2]) == [1, 1, 0]
    assert run([0, -1, -1, 1], heading=[1, 2]) == [0, 1, 1, 1]
    assert run([1, -1, -1, 0], heading=[1]) == [1, 0, 0, 0]
    assert run([-1, -1], main=[1]) == [0, 1]
    assert run([]) == []


def test_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", "x"), (1, "u", page(f"<article><p>{LONG}"), "x"), (3, "u", "<article>" + "<p>wörd " * 20_000, "x"), (4, "u", "<" * 5000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", 0), (2, None, 0), (None, "u", 0), (1, "u", len(LONG)), (3, "u", 20_000 * 5 - 1), (4, "u", 0)]
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    assert H.extract(pages.limit(0)).collect() == []


def test_table_has_whole_articles(spark):
    """The pages of the table mark their article: everything between its tags and nothing else."""
    import html
    import re

    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op9(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in want if b)
