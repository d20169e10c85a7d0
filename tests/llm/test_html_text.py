from roadweave.llm.html_text import extract, main_text

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header><h1>Site name</h1></header><nav><ul><li><a href="/a">menu</a></li><li><a href="/b">more</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy this now, it is cheap and good and long enough to look like text.</div>'
    '<div id="cookie-notice"><p>We use cookies to make this page better for you, please agree to them.</p></div>'
    "<article><h1>A title</h1><p><b>First &amp; longest paragraph,\n  which has    many words and goes on.<br><p>Short.</p>"
    '<aside>See also these things</aside><div class="share-buttons">Share</div><form>Name <input> and <label>mail</label></form>'
    "<p>Last paragraph with a <a href=x>link in it</a> and &lt;tags&gt; &#233;.</article>"
    '<section class="comments"><article class="comment"><p>I liked this article a lot, thanks for writing all of it!</p></article></section>'
    "<footer>&copy; somebody</footer></body></html>"
)


def test_parts_of_a_page():
    assert main_text(PAGE) == "A title\nFirst & longest paragraph, which has many words and goes on.\nShort.\nLast paragraph with a link in it and <tags> é."


def test_page_without_article():
    links = "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(12))
    body = "".join(f"<p>{'A sentence of the text that matters here. ' * 4}{i}</p>" for i in range(6))
    text = main_text(f"<body><ul>{links}</ul><h2>About</h2>{body}<ul>{links}</ul></body>")
    assert text.startswith("About\nA sentence") and text.count("\n") == 6 and "entry" not in text


def test_broken_and_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>a") == ""
    assert main_text("just text") == "just text"
    assert main_text("<form id=aspnet><article><p>Inside the form.</p></article></form>") == "Inside the form."
    assert main_text("<article>a</b></div> b<p>c<p>d") == "a\nb\nc\nd"
    assert len(main_text("<article>" + "<p>word &amp; word</p>" * 50_000)) == 50_000 * 12 - 1


def test_table(spark):
    rows = [(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (None, None, None, None, None), (2, "v", "", "y", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = main_text(PAGE)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_do_not_hide_articles():
    body = "<p>The text of the page, long enough to be read.</p>"
    want = "The text of the page, long enough to be read."
    for page in (
        f"<form id=aspnet><div><div><article>{body}</article></div></div></form>",
        f"<div class='site has-sidebar'><article>{body}</article></div>",
        f"<div class='no-sidebar'><div>{body}</div></div>",
        f"<article class='post comments-open'>{body}</article>",
        f"<main class='with-sidebar'>{body}</main>",
    ):
        assert main_text(page) == want, page
    for page in (f"<div class=sidebar><article>{body}</article></div>", f"<aside><div><article>{body}</article></div></aside>", f"<form>{body}</form>"):
        assert main_text(page) == "", page


def test_text_beside_teaser_articles():
    text = "".join(f"<p>{'A sentence of the text that matters here. ' * 4}{i}</p>" for i in range(6))
    teasers = "".join(f"<article><a href=/{i}>Teaser {i}</a></article>" for i in range(4))
    got = main_text(f"<div>{text}</div><div>{teasers}</div>")
    assert got.count("A sentence") == 24 and "Teaser 3" not in got


def test_class_words_that_do_not_say_boilerplate():
    body = "<p>The text of the page, long enough to be read.</p>"
    want = "The text of the page, long enough to be read."
    for page in (
        f'<article class="post category-social tag-newsletter">{body}</article>',
        f'<div class="search-results"><article>{body}</article></div>',
        f'<div class="comment-free">{body}</div>',
        f'<div class="search-results">{body}</div><div class="cookie-notice"><p>We use cookies.</p></div>',
    ):
        assert main_text(page) == want, page
    for name in ("comments", "comment-list", "disqus_thread", "reader-comments"):
        readers = "<p>I liked this article a lot, thanks for writing all of it!</p>" * 20
        assert main_text(f"<article>{body}</article><div class='{name}'>{readers}</div>") == want
        assert main_text(f"<div>{body}</div><section id='{name}'><article class=comment>{readers}</article></section>") == want


def test_blocks_end_open_paragraphs_and_items():
    text = "".join(f"<p>{'A sentence of the text that matters here. ' * 4}{i}</p>" for i in range(3))
    for start in ("<p class='notice'>Notice: old.", "<p class=ad>Buy.<b>Now", "<ul><li class=ad>Buy.<li>One</ul>"):
        got = main_text(f"<article>{start}<h2>Head</h2>{text}</article>")
        assert got.count("A sentence") == 12 and "Head" in got and "Buy" not in got and "Notice" not in got, start
    assert main_text("<article><p>Let <math><mi>x</mi><annotation>x^2</annotation></math> hold.</p></article>") == "Let x hold."


def test_short_paragraphs_of_a_block_stay():
    text = "".join(f"<p>{'A sentence of the text that matters here. ' * 4}{i}</p>" for i in range(5))
    links = "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(12))
    got = main_text(f"<div><ul>{links}</ul></div><div>{text}<p>Yes.</p><p>No.</p><p>So.</p><p>End.</p></div><div><ul>{links}</ul></div>")
    assert got.endswith("Yes.\nNo.\nSo.\nEnd.") and "entry" not in got


def test_deep_nesting():
    assert main_text("<div>" * 20_000 + "Deep text." + "</div>" * 20_000) == "Deep text."
