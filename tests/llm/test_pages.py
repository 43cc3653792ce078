"""Main text on pages of the test tables, whose parts were told apart by reading them, and on hostile ones."""

import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from lodestrum.llm import html_tree

DATA = Path("/root/testdata/sf0.01/pages.parquet")


class ArticleBlocks(HTMLParser):
    """These pages have one article, whose headings and paragraphs are their blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.on:
            self.blocks[-1].append(data)


def by_rule(source):
    parser = ArticleBlocks()
    parser.feed(source)
    parser.close()
    return "\n\n".join(b for b in (" ".join("".join(x).split()) for x in parser.blocks) if b)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(str(DATA))
    want = {r["page_id"]: by_rule(r["html"] or "") for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_tree.main_text(pages).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)


#: Labelled by hand: a page, and its blocks of main text.
BY_HAND = [
    (
        '<html><head><title>T</title></head><body><header><a href="/">Site name</a><nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav></header>'
        '<div class="cookie-notice">We use cookies. <button>Accept</button></div><main><article><h1>The bridge</h1><p>It was built in 1930, of stone, by <em>two</em> firms.</p>'
        "<p>It carries <a href=x>a road</a> and a path.</p><ul><li>Length: 300 m, with ramps.</li><li>Height: 40 m.</li></ul></article>"
        '<aside class="related"><h3>More</h3><ul><li><a href=1>Other bridges</a><li><a href=2>Towers</a></ul></aside></main>'
        '<section id="comments"><div class=comment><b>Ann</b><p>I walked over it, it is high.</p></div></section><footer>&copy; Site <a href=/imprint>Imprint</a></footer></body></html>',
        ["The bridge", "It was built in 1930, of stone, by two firms.", "It carries a road and a path.", "Length: 300 m, with ramps.", "Height: 40 m."],
    ),
    (
        "<body><nav><a href=1>Home</a> <a href=2>About</a></nav><article><h1>Formula</h1><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, as was shown.</p>"
        "<p>A drawing: <svg><path d=1/><text>the axis</text></svg> is marked.</p><pre>one  two\nthree</pre></article><form><label>Search</label><input name=q><button>Go</button></form><footer>End</footer>",
        ["Formula", "Here x=2 holds, as was shown.", "A drawing: the axis is marked.", "one two three"],
    ),
    ("<body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><footer>Nothing here &copy; 2020</footer>", []),
]


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2021 The Valley Paper. All rights reserved.</p></footer>"
ONE = "The river rose by two metres in the night, and the lower road was closed."
TWO = "Nobody was hurt. The mayor, who had slept in the town hall, said the walls had held."
THREE = "Repairs will begin next week, as soon as the water has gone down."
FOUR = "Most shops in the lower town hope to open again by Monday, said their owners."
STORY = [ONE, TWO, THREE, FOUR]
PS = "".join(f"<p>{t}</p>" for t in STORY)
TITLE = "<h1>Flood in the valley</h1>"
#: Written by hand for these tests, in layouts that the module's own pages don't have as such: name, page, blocks.
LAYOUTS = [
    ("bare div", f"<body>{NAV}<div>{PS}</div>{FOOT}", STORY),
    ("body alone", f"<body>{PS}</body>", STORY),
    ("no body", PS, STORY),
    ("body beside nav", f"<body>{NAV}{TITLE}{PS}{FOOT}", ["Flood in the valley", *STORY]),
    ("unknown id", f"<body>{NAV}<div id=maincontent>{PS}</div>{FOOT}", STORY),
    ("unknown class", f'<body>{NAV}<div class="css-1x9zq">{TITLE}{PS}</div>{FOOT}', ["Flood in the valley", *STORY]),
    ("misleading class", f'<body>{NAV}<article class="comments-enabled">{PS}</article>{FOOT}', STORY),
    ("misleading body", f'<body class="has-sidebar menu-closed"><div class="page">{NAV}<div class=content>{TITLE}{PS}</div></div>{FOOT}', ["Flood in the valley", *STORY]),
    ("nested divs", f"<div><div><div><div>{TITLE}{PS}</div></div></div></div>", ["Flood in the valley", *STORY]),
    ("table layout", f"<table><tr><td><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Sport</a></ul></td><td>{TITLE}{PS}</td></tr></table>", ["Flood in the valley", *STORY]),
    ("sidebar", f'<body>{NAV}<main>{TITLE}{PS}</main><aside><h3>Most read</h3><ul><li><a href=1>A new bridge</a></li><li><a href=2>The old mill</a></li></ul></aside>{FOOT}', ["Flood in the valley", *STORY]),
    ("comments", f'<article>{TITLE}{PS}</article><div id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>We saw it from the hill, it was terrible.</p></div><div class="comment"><b>Bo</b><p>Glad nobody was hurt.</p></div></div>', ["Flood in the valley", *STORY]),
    ("advert inside", f'<article>{TITLE}<p>{ONE}</p><div class="ad">Buy new boots today!</div><p>{TWO}</p><p>{THREE}</p></article>', ["Flood in the valley", ONE, TWO, THREE]),
    ("cookie notice", f'<div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><main>{TITLE}{PS}</main>', ["Flood in the valley", *STORY]),
    ("login form", f'<form id=login><label>Name</label><input name=u><label>Word</label><input name=p><button>Enter</button></form><div class="post">{TITLE}{PS}</div>', ["Flood in the valley", *STORY]),
    ("select menu", f"<form><select><option>Choose a town</option><option>Upper town</option><option>Lower town</option></select></form><article>{TITLE}{PS}</article>", ["Flood in the valley", *STORY]),
    ("unclosed select", f"<article>{TITLE}{PS}</article><form><select><option>Choose a town<option>Upper town</form>", ["Flood in the valley", *STORY]),
    ("unclosed frame", f"<body><iframe src=x><article>{TITLE}{PS}</article>", ["Flood in the valley", *STORY]),
    ("script with tags", f'<script>document.write("<p>No text of this page at all.</p>");</script><article>{TITLE}{PS}</article><style>p::after {{content: "<p>"}}</style>', ["Flood in the valley", *STORY]),
    ("comment with tags", f"<article>{TITLE}<!-- <p>An older form of it.</p> -->{PS}</article>", ["Flood in the valley", *STORY]),
    ("headings and lists", f"<main>{TITLE}<p>{ONE}</p><h2>What is closed</h2><ul><li>The lower road, up to the bridge.</li><li>The school in Mill Lane, for today.</li></ul><p>{TWO}</p></main>", ["Flood in the valley", ONE, "What is closed", "The lower road, up to the bridge.", "The school in Mill Lane, for today.", TWO]),
    ("quotation", f"<article>{TITLE}<p>{ONE}</p><blockquote><p>I have never seen so much water here, in forty years.</p></blockquote><p>{TWO}</p></article>", ["Flood in the valley", ONE, "I have never seen so much water here, in forty years.", TWO]),
    ("unclosed paragraphs", f"<article>{TITLE}" + "".join(f"<p>{t}" for t in STORY) + "</article>", ["Flood in the valley", *STORY]),
    ("links in prose", f'<article>{TITLE}<p>The river rose by <a href=1>two metres</a> in the night, as the <a href=2>weather office</a> had said.</p><p>{TWO}</p></article>', ["Flood in the valley", "The river rose by two metres in the night, as the weather office had said.", TWO]),
    ("references", "<article><h1>Caf&eacute; &amp; mill</h1><p>It costs &lt; 5 &#8364;, and it&#x2019;s open.</p><p>" + TWO + "</p></article>", ["Café & mill", "It costs < 5 €, and it’s open.", TWO]),
    ("white space", f"<article>{TITLE}<p>\n   {ONE[:20]}\n\t{ONE[20:]}  </p><p>{TWO}</p></article>", ["Flood in the valley", " ".join(f"{ONE[:20]} {ONE[20:]}".split()), TWO]),
    ("breadcrumb and share", f'<div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/n>News</a></div><article>{TITLE}{PS}</article><div class="share"><a href=1>Send</a> <a href=2>Print</a></div>', ["Flood in the valley", *STORY]),
    ("newsletter", f'<article>{TITLE}{PS}</article><div class="newsletter"><p>Get our letter every morning.</p><form><input name=m><button>Subscribe</button></form></div>', ["Flood in the valley", *STORY]),
    ("related below", f'<div id="content">{TITLE}{PS}</div><div class="related"><h3>More from the valley</h3><ul><li><a href=1>The dam of 1911</a></li><li><a href=2>Who pays for it?</a></li></ul></div>{FOOT}', ["Flood in the valley", *STORY]),
    ("navigation alone", f"<body>{NAV}<ul><li><a href=1>Page one</a></li><li><a href=2>Page two</a></li></ul>{FOOT}", []),
    ("nothing", "", []),
    ("unbalanced quote", f"<article>{TITLE}<p>{ONE}</p><p title=\"x>{TWO}</p></article>" + NAV.replace('"', "") + '<p>"', ["Flood in the valley", ONE]),
]


@pytest.mark.parametrize(("source", "blocks"), BY_HAND)
def test_pages_labelled_by_hand(source, blocks):
    assert html_tree.trained().extract(source) == "\n\n".join(blocks)


@pytest.mark.parametrize(("name", "source", "blocks"), LAYOUTS)
def test_layouts(name, source, blocks):
    assert html_tree.trained().extract(source) == "\n\n".join(blocks)


@pytest.mark.parametrize("source", ["<div>" * 8000 + "</p>" * 8000, "<x-foo>" * 40000 + "<hr>" * 40000, "<p><div>" + "<x-foo>" * 20000 + "<p>a" * 20000, "<td>" * 20000 + "</table>" * 20000, "<b>" * 50000 + "a" + "</b>" * 50000])
def test_hostile_pages_take_time_in_proportion(source):
    began = time.perf_counter()
    once = html_tree.parse(source)
    first = time.perf_counter() - began
    began = time.perf_counter()
    html_tree.parse(source * 4)
    assert time.perf_counter() - began < 12 * first + 0.5 and len(once.tags) >= 1


MEGABYTE = 1 << 20
HOSTILE = {
    "open tag": "<p>x</p>" + "<a " * (MEGABYTE // 3) + '"> y', "quotes": '<a "' * (MEGABYTE // 4), "mixed quotes": "<a b='\"'" * (MEGABYTE // 8), "titles": "<title>" * (MEGABYTE // 7),
    "ends of a title": "<title>" + "</title " * (MEGABYTE // 8), "frames": "<iframe>" * (MEGABYTE // 8), "brackets": "<" * MEGABYTE, "comments": "<!--" * (MEGABYTE // 4),
    "digits": "&#" + "9" * MEGABYTE + ";", "ampersands": "&" * MEGABYTE, "classes": "<p " + "class=" * (MEGABYTE // 6) + ">x", "names": '<div class="' + " ".join(f"w{i}" for i in range(50000)) + '">' + "a<hr>" * 50000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_a_hostile_megabyte_is_parsed_at_once(kind):
    began = time.perf_counter()
    html_tree.parse(HOSTILE[kind])
    assert time.perf_counter() - began < 2


def test_long_references():
    assert html_tree.plain_text(["&#00000000000000065; &#x0000000000000000042; &#" + "9" * 9999 + "; &#67;"]) == "A B � C"


def test_awkward_rows(spark):
    long = "<article>" + "<p>Some words, as there are many.</p>" * 20000
    rows = [(1, "u", "<p>"), (1, "u", "<p>"), (None, None, None), (2, "v", ""), (3, "w", long)]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_tree.main_text(pages).collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert next(r for r in out if r["page_id"] == 3)["text"].count("\n\n") == 19999
    assert html_tree.main_text(pages.limit(0)).collect() == []
