"""HTML extraction: pages on which parts of the main text were lost."""

from ledgerlens.llm import html_text

LONG = ("This is the main text of the page and it has many of the words that are in all of the texts, so that it is "
        "clear to all that it was written for a reader who will be with us to the end of it.")
LONGER = f"{LONG} And so it goes on to the end of the page, as it is for the reader and for all who are with them."


def test_both_passes_act_beside_an_article():
    page = (f"<body><nav><a href=1>Menu</a></nav><p>By the menu</p><p>x</p><h1>Title</h1><div>{LONGER}</div><p>Short.</p>"
            f"<div>{LONGER}</div><div>{'zzz ' * 60}</div><p>By the noise</p><article><p>A teaser</p></article></body>")
    assert html_text.main_text(page) == f"x\nTitle\n{LONGER}\nShort.\n{LONGER}\nA teaser"
    # a block that is clear on a page without an article is only followed here
    assert html_text.main_text(f"<nav>m</nav><div>{LONG}</div><article><p>Text</p></article>") == "Text"
    assert html_text.main_text(f"<h1>Title</h1><article><p>{LONG}</p></article>") == f"Title\n{LONG}"


def test_self_closed_and_unclosed_parts_are_empty():
    for tag in ("svg", "math", "object", "iframe", "template", "canvas", "noscript"):
        for mark in (f'<{tag} class="i"/>', f"<{tag} />", f"<{tag}>"):
            page = f"<article><p>one {mark} two</p><p>three</p></article>"
            assert html_text.main_text(page) == "one two\nthree"
    assert html_text.main_text("<nav><svg/>Menu</nav><article><p>one<svg><text>no</text></svg>two</p></article>") == "one two"
    assert html_text.main_text("<article><p>one <svg-icon>two</svg-icon></p><p>three</article>") == "one two\nthree"
    assert html_text.main_text("<article><p>one</p><script src=x>two</p><p>three</article>") == "one"


def test_inline_objects_hold_text():
    page = ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here</p><p><object>A map</object>of it</p>"
            "<p><canvas>A chart</canvas></p><noscript><p>A picture</p></noscript></article>")
    assert html_text.main_text(page) == "So x=1 here\nA map of it\nA chart\nA picture"


def test_linked_text_of_an_article_stays():
    link = "<a href=x>{}</a>".format
    sources = "".join(f"<li>{link('The title of a work')} by {name}, 2001" for name in ("Ash", "Birch", "Cedar"))
    titles = "".join(f"<li>{link(f'{LONG[:80]} {i}')}" for i in range(3))
    page = (f"<article><h2>{link('Title')}</h2><p>See {link('the linked report of the year')}.</p><p>{LONG}</p>"
            f"<ol>{sources}</ol><p>and</p><ul>{titles}</ul><p>End</p><ul>{''.join('<li>' + link(x) for x in 'One Two Three'.split())}</ul>"
            f"</article><p>{link('More')}</p>")
    want = ["Title", "See the linked report of the year.", LONG,
            *(f"The title of a work by {name}, 2001" for name in ("Ash", "Birch", "Cedar")), "and",
            *(f"{LONG[:80].strip()} {i}" for i in range(3)), "End"]
    assert html_text.main_text(page) == "\n".join(want)
    # one menu, and its blocks only
    assert html_text.main_text(f"<article><p>{link('a')}</p><p>{link('b')}</p></article>") == "a\nb"


def test_marked_blocks_and_spans_are_not_main_text():
    page = (f"<article><h1 class=header>Title</h1><p class='ad'>{LONG}<p>One</p><blockquote class=comment><p>{LONG}</p>said</blockquote>"
            f"<p>Two <span class=advert>Buy <span>now</span> all</span>and <span class=x>three</span></p><h3 class=related>More</h3>"
            f"<ul><li hidden>no<ul><li>no</ul><li>Four<li style='display: none'><p>no</p></li><li>Five</ul><p>Six"
            f"<pre class=notice>no</pre><p>Seven <span hidden>no<p>Eight</p><dl><dt id=ads>no<dd>Nine</dl></article>")
    assert html_text.main_text(page) == "Title\nOne\nTwo and three\nFour\nFive\nSix\nSeven\nEight\nNine"
    items = "<li>" * 20000
    assert html_text.main_text(f"<article><p>a</p>{items}b</article>") == "a\nb"
