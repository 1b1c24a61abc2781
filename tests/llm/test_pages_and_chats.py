"""HTML extraction and chat formatting."""

import duckdb

from strandloom.llm import chat, html_text
from strandloom.llm.queries import ORACLE_SQL

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><a href="/">Home</a> <a href="/b">Blog</a></header><nav><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all, please, they are good for you.</div>
<div id="main"><h1>The &amp; title</h1><p>First   paragraph,\nlong enough to be text &mdash; really.<p>Second <b>bold</b> one<br>goes on for a while here.
<script>var t="</p>";</script><ul><li>item one of the list<li>item two of the list</ul><blockquote>Quoted words.</blockquote></div>
<aside>Sidebar words</aside><div class="comments"><p>Great post!</p></div><form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


def test_extract():
    assert html_text.extract(PAGE) == "The & title\nFirst paragraph, long enough to be text — really.\nSecond bold one goes on for a while here.\nitem one of the list\nitem two of the list\nQuoted words."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("just text &lt;b&gt; 1 < 2") == "just text <b> 1 < 2"
    assert html_text.extract("<p>open <b>never<br><p>closed") == "open never\nclosed"
    assert html_text.extract("<article><p>some text</p><div class='ad'>buy</div><section><p>more</p></section></article><p>rest") == "some text\nmore"
    assert html_text.extract('<p title="a > b">x</p><!-- <p>no</p> --><p>y') == "x\ny"
    assert html_text.extract("<p>" * 3000 + "deep") == "deep"
    assert html_text.extract("<div>" * 3000 + "deep") == "deep"


def test_names_of_wrappers():
    story = "<p>" + "A sentence of the story, with words enough. " * 4 + "</p><p>The end of it.</p>"
    want = html_text.extract(f"<body><div>{story}</div></body>")
    assert want.endswith("The end of it.")
    for name in ("content has-sidebar", "post with-comments", "no-sidebar", "hasSidebar", "page-header-image", "widget", "sidebar-right"):
        assert html_text.extract(f"<body><div class='{name}'>{story}</div></body>") == want
    assert html_text.extract(f"<body><div class='content-sidebar'><article>{story}</article></div><div class='related'>{'<p>Read this one too, it is very good.</p>' * 20}</div></body>") == want
    long = f"<div>{story * 3}</div>"
    for name in ("sidebar", "sidebar-left", "site-footer", "comments-area", "ad"):
        assert html_text.extract(f"<body>{long}<div class='{name}'>{story}</div></body>") == html_text.extract(f"<body>{long}</body>")


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x"), (3, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in html_text.main_text(pages).collect())
    n = len(html_text.extract(PAGE))
    assert got == [(1, n, n), (1, n, n), (2, 0, 0), (3, 0, 0)]
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_chats(spark):
    turns = [(c, t, "user" if t % 2 else "assistant", f"text {t}") for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for t in range(n)]
    turns += [(5, 0, "assistant", "text 0"), (5, 1, "user", "another"), (6, 0, None, None), (None, 0, "user", "x"), (7, None, "user", "no turn"), (7, 0, "user", "no turn"), (8, 0, "user", "same"), (8, 0, "user", "same")]
    data = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "'x' as h1")
    got = {r.conv_id: r for r in chat.render(data).collect()}
    assert set(got) == {2, 5, 6, None, 7, 8} and got[2].n_snapshots == 2 and got[2].n_turns == 4
    assert got[6].chat == "<|im_start|>\n<|im_end|>\n" and got[8].chat == "<|im_start|>user\nsame<|im_end|>\n" * 2
    assert chat.render(data.limit(0)).collect() == []


def test_chats_equal_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    duckdb.sql(f"create or replace view conversations as from '{path}'")
    want = sorted(duckdb.sql(ORACLE_SQL["op2_chat_format"]).fetchall())
    assert sorted(tuple(r) for r in chat.render(spark.read.parquet(path)).collect()) == want


def test_lists_of_links():
    story = "<p>" + "A sentence of the story, with words enough. " * 4 + "</p>"
    links = "".join(f"<li><a href='/{i}'>Link number {i}</a>" for i in range(4))
    shown = "\n".join(f"Link number {i}" for i in range(4))
    for page in (f"<article>{story}{story}<ul>{links}</ul></article>", f"<div><h1>T</h1>{story}{story}<h2>References</h2><ol>{links}</ol></div>"):
        assert shown in html_text.extract(f"<body><ul>{links}</ul>{page}<ul>{links}</ul></body>") and html_text.extract(f"<body><ul>{links}</ul>{page}<ul>{links}</ul></body>").count("Link number 0") == 1
    for page in (f"<article><ul>{links}</ul>{story}{story}</article>", f"<article>{story}{story}<ul class='related'>{links}</ul></article>", f"<article>{story}{story}</article><ul>{links}</ul>"):
        assert "Link number" not in html_text.extract(f"<body>{page}</body>")
