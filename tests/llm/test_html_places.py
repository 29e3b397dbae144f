import pytest

from spindrift.llm import html_extract as H

LONG = "these are the words of a paragraph that is long enough to be kept on any page of its own, with no link in it at all"


def text_of(page):
    return H.main_text(page, H.trained())


@pytest.mark.parametrize("tag", ['main class="site-main has-sidebar"', 'article class="post category-social tag-legal"', 'article id="post-search" class="post comments-open"', 'main id="skip"'])
def test_names_do_not_drop_an_article(tag):
    assert text_of(f"<body><{tag}><h1>Title</h1><p>{LONG}</p></{tag.split()[0]}></body>") == f"Title\n{LONG}"


@pytest.mark.parametrize("inner", ['<article class="comment">', '<article id="div-comment-5" class="comment-body">'])
def test_comments_stay_out(inner):
    for area in ('<div id="comments">', '<section id="comments">', '<ol class="comment-list"><li>', ""):
        assert text_of(f"<body><main><p>{LONG}</p></main>{area}{inner}<p>nice one, and so on, {LONG}</p></article></body>") == LONG
    assert text_of("<body><section id=comments><article><p>nice one</p></article></section></body>") == ""


@pytest.mark.parametrize("start", [
    "<p><a name=top>Top</p>", "<div><a href=/>Home</div>", "<a name=top>", "<p><a name=a>x<a name=b>y</a></p>", "<div><a href=/>one<a href=/b>two</a></div>", "<p><a href=/>x<a href=/y>y</p>",
])
def test_an_open_link_ends(start):
    got = text_of(f"<body>{start}<div><p>{LONG}</p></div><div><p>{LONG}</p></div></body>")
    assert got.split("\n")[-2:] == [LONG, LONG]


def test_links_stay_links():
    got = text_of(f'<body><div><p>{LONG}</p></div><ul><li><a href="/a">one of the many other pages that may be read here on this site</a><li><a href="/b">and the next one of those pages that may be read here</a></ul></body>')
    assert got == LONG


@pytest.mark.parametrize("page", ['<article class="post related-topic"><p>hello there world</p></article>', "<article><p class=share-price>hello there world</p></article>", "<body><main><div class=share-price><p>hello there world</p></div></main></body>"])
def test_names_are_a_weak_hint(page):
    assert text_of(page) == "hello there world"


def test_a_page_without_article_or_main():
    menu = '<div class="top"><a href="/a">Home</a> <a href="/b">News</a></div>'
    foot = "<div class=footer>&copy; 2020 by the site</div>"
    assert text_of(f"<html><body>{menu}<div><h1>Title of it</h1><p class=share-price>{LONG}</p><p>{LONG}</p></div>{foot}</body></html>") == f"Title of it\n{LONG}\n{LONG}"
    assert text_of(f"{menu}<table><tr><td>{LONG} {LONG}</td></tr></table>") == f"{LONG} {LONG}"
    assert text_of("") == "" and text_of("no tags, but some words that are enough of a text to be kept here, one would say, and then some") != ""


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a href='", "<div></span>", "<div>x", "<section><main>", "<div><a href=/>x", "<!--", "<script>", "</", "<p class=", "&amp;", "<b", "= <a =  "])
def test_long_and_hostile_pages(unit):
    """Time is linear in a page's length, whatever its markup."""
    import time

    began = time.process_time()
    H.blocks(unit * (1_000_000 // len(unit)))
    took = time.process_time() - began
    assert took < (1 if unit == "<a " else 20)


def test_attributes_hold_signs():
    assert text_of(f'<body><article title="a > b"><p data-x=\'<p>\' id=it\'s>{LONG}</p></article><p>x</p></body>') == LONG


def test_odd_pages(spark):
    schema = "page_id long, html string, url string, node string, text string, words int"
    data = [(1, f"<article><p>{LONG}</p></article>", "u", "n", "old", 3), (None, None, None, None, None, None), (1, f"<article><p>{LONG}</p></article>", "u", "n", "old", 3), (2, "<article><p>" + f"{LONG} " * 20_000, "u", "n", "", 0)]
    out = H.extract(spark.createDataFrame(data, schema))
    assert out.columns == ["page_id", "url", "node", "words", "text", "n_chars"]
    got = [(r["page_id"], r["node"], r["words"], r["n_chars"]) for r in out.collect()]
    assert got == [(1, "n", 3, len(LONG)), (None, None, None, 0), (1, "n", 3, len(LONG)), (2, "n", 0, (len(LONG) + 1) * 20_000 - 1)]
    assert H.extract(spark.createDataFrame([], schema)).count() == 0


def test_links_in_an_article_stay():
    assert text_of(f"<article><p>{LONG}</p><ul><li><a href=/>First source</a><li><a href=/b>Second</a></ul><p><a href=/c>One more</a></p></article>") == f"{LONG}\nFirst source\nSecond\nOne more"


@pytest.mark.parametrize("box", ["<div class=ad>Buy</div>", "<div class='ad-slot'>Buy this now, it is cheap and good</div>", "<form><p>Your name</p></form>", f"<form><p>{LONG}</p></form>", "<aside><p>aside it says this</p></aside>", "<ul class=share-links><li>Share<li>Like</ul>", "<nav><a href=/>Next page</a></nav>", "<aside><ul><li><a href=/>a page</a><li><a href=/b>another</a></ul></aside>", "<footer><a href=/>Author</a></footer>"])
def test_boxes_between_paragraphs(box):
    for n in (1, 2, 5):
        assert text_of(f"<body><article><p>{LONG}</p>{box}<p>{' '.join([LONG] * n)}</p></article></body>") == f"{LONG}\n{' '.join([LONG] * n)}"


def test_links_within_paragraphs():
    """Without an article, a paragraph with some links stays."""
    para = f"{LONG} and <a href=/x>two words</a> more, {LONG}"
    assert text_of(f"<body><div><a href=/>Home</a></div><div><p>{para}</p><p>{LONG}</p><p>{para}</p></div></body>") == "\n".join([para.replace("<a href=/x>", "").replace("</a>", ""), LONG, para.replace("<a href=/x>", "").replace("</a>", "")])


@pytest.mark.parametrize("name", ["post-comments", "comments__list", "reader-comments", "userComments", "comment-list", "commentlist", "fb-comments", "entry_comments comments-3", "replies"])
def test_readers_comments_go(name):
    said = f"<p>{LONG} says a reader</p>"
    assert text_of(f'<body><article><p>{LONG}</p><section class="{name}">{said}</section></article></body>') == LONG
    assert text_of(f'<body><main><p>{LONG}</p><div class="{name}"><article class="comment">{said}</article></div></main></body>') == LONG
    assert text_of(f'<body><p>{LONG}</p><p>{LONG}</p><div id="{name}">{said}</div></body>') == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["post has-comments", "post-4 comments-open", "entry post-comments", "commentary", "comment-policy-explained"])
def test_names_that_only_speak_of_comments(name):
    assert text_of(f'<body><article class="{name}"><p>{LONG}</p></article></body>') == LONG


@pytest.mark.parametrize("bar", [f'<div class="cookie-bar"><p>{LONG}</p></div>', f"<div><p>{LONG}</p><p>{LONG}</p></div>", f"<section class=notice>{LONG}</section>"])
def test_nothing_beside_an_article_is_kept(bar):
    assert text_of(f"<body>{bar}<article><p>{LONG}</p></article></body>") == LONG
    assert text_of(f"<body><main><p>{LONG}</p></main>{bar}</body>") == LONG


def test_labels_of_link_lists_go():
    """Short blocks tell nothing by themselves: what follows them is links, or the text's next paragraph."""
    links = "<ul><li><a href=/1>what the people of that town have said about it</a><li><a href=/2>why the bridge was closed for so long a time</a></ul>"
    assert text_of(f"<body><div><p>{LONG}</p><p>No.</p><p>{LONG}</p></div><div>Read more</div>{links}</body>") == f"{LONG}\nNo.\n{LONG}"
