import html
import random
import re

import pytest

from codeassay.llm import page_diff as pd

DDL = "page_id long, url string, html string, host string"


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        up, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(up[j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


@pytest.mark.parametrize("seed", range(4))
def test_alignment_is_a_longest_common_subsequence(seed):
    r = random.Random(seed)
    for _ in range(150):
        letters = r.choice([2, 3, 8, 30])
        a, b = ([str(r.randrange(letters)) for _ in range(r.randrange(80))] for _ in range(2))
        in_a, in_b = pd.common_lines(a, b)
        assert len(in_a) == longest(a, b)
        assert [a[i] for i in sorted(in_a)] == [b[i] for i in sorted(in_b)]


def texts(page):
    return pd.main_text(pd.blocks_of(page.encode()), set()).split("\n")


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<article><h1>T &amp; x</h1><p>a\n  b<p>c<br>d</article><p>out", ["T & x", "a b", "c d"]),
        ("<nav>menu</nav><main><p>one <b>two</b></p><aside>no</aside><form>no</form></main><footer>f", ["one two"]),
        ("<article><p>a<script>var t='</p>'</script></p><div class='comments'><p>me too</p></div><p>b</article>", ["a", "b"]),
        ("<article><p>x <button>buy</button> y</p><div id=cookie-notice>ok?</div></article>", ["x y"]),
        ("<article><header><h1>Head</h1></header>text<ul><li>1<li>2</ul></article>", ["Head", "text", "1", "2"]),
        ("<body><div class='sidebar'>s</div><div>only text</div></body>", ["only text"]),
        ("<article><p>&am</p><p>&amp</p>&quo &#8212;&nbsp;x</article>", ["&am", "&", "&quo — x"]),
        ("<article><p><b>open<br><p>next</p></article>", ["open", "next"]),
        ("no markup at all", ["no markup at all"]),
        ("<article></article>", [""]),
        ("<article><p>loaded advertising header notes</p><p class='lead heading'>kept</p></article>", ["loaded advertising header notes", "kept"]),
    ],
)
def test_blocks(page, wanted):
    assert texts(page) == wanted


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<div class='has-sidebar'><p>a</p></div>", ["a"]),
        ("<main class='no-sidebar'><p>a</p></main>", ["a"]),
        ("<main class='search'><p>a</p></main>", ["a"]),
        ("<article class='post tag-search category-social comments-open'><p>a</p></article>", ["a"]),
        ("<article><div class='entry-header'><h1>T</h1></div><p>a</p></article>", ["T", "a"]),
        ("<div class='sidebar'><div class='ad'>x</div><article>a</article></div><div class='menu'>m</div>", ["a"]),
        ("<div id='search'><div class='widget'><main>a <span class='ad'>x</span> b</main></div></div>", ["a b"]),
        ("<article>a<div class='comments'><article>me too</article></div></article>", ["a"]),
    ],
)
def test_names_of_page_parts(page, wanted):
    assert texts(page) == wanted


def brute(rows):
    """Every pair of neighbours over the whole sorted table."""
    order = sorted(rows, key=lambda r: (*pd.place_of((r[1] or "").encode()), r[1] or "", r[0]))
    pages = [(r[0], pd.place_of((r[1] or "").encode())[0], pd.blocks_of(r[2] and r[2].encode()), set()) for r in order]
    for a, b in zip(pages, pages[1:], strict=False):
        if a[1] == b[1]:
            left, right = pd.shared_blocks(a[2], b[2])
            a[3].update(left)
            b[3].update(right)
    return {p[0]: (pd.main_text(p[2], p[3]), len(p[3])) for p in pages}


def site(n, r):
    for i in range(n):
        host = "big.example" if i % 3 else f"h{i % 5}.example"
        lines = [f"story {i} line {k} {r.random()}" for k in range(r.randrange(1, 6))]
        template = [f"Welcome to {host}", *lines, f"All about {host}"]
        yield i, f"https://{host}/a/{r.randrange(10**6)}?x={i}", "".join(f"<div>{x}</div>" for x in template), "h"


def test_differencing_finds_unmarked_template_lines(spark):
    rows = list(site(150, random.Random(7)))
    found = pd.extract_pages(spark.createDataFrame(rows, DDL).repartition(7))
    got = {r.page_id: (r.text, r.n_shared) for r in found.collect()}
    assert got == brute(rows)
    assert "Welcome" not in got[1][0] and "story 1 line 0" in got[1][0]


def test_differencing_decides_beside_and_in_articles(spark):
    """A body in plain divs beside teasers; a menu in main; a paragraph that all articles share."""
    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    menu, teaser, note = words(20), words(15), words(5)
    bodies = {h: [words(60) for _ in range(5)] for h in "abc"}
    page = {
        "a": lambda x: f"<div>{menu}</div><div>{x}</div><article class='card'>{teaser}</article>",
        "b": lambda x: f"<main><div>{menu}</div><div>{x}</div></main>",
        "c": lambda x: f"<div>{menu}</div><article><p>{x}</p><p>{note}</p></article>",
    }
    rows = [(n, f"https://{h}/{i}", page[h](x), h) for n, (h, i, x) in enumerate((h, i, x) for h in page for i, x in enumerate(bodies[h]))]
    got = {x.url: x.text for x in pd.extract_pages(spark.createDataFrame(rows, DDL)).collect()}
    for h in page:
        for i, body in enumerate(bodies[h]):
            text = got[f"https://{h}/{i}"]
            assert body in text
            assert (note in text) == (h == "c")
            if 0 < i < 4:  # the first and last page have one neighbour: not enough to take from an article
                assert menu not in text and teaser not in text
    alone = "<div>" + "body " * 50 + "</div><article class='card'>teaser</article>"
    assert "body body" in pd.main_text(pd.blocks_of(alone.encode()), set())


def test_results_do_not_depend_on_ranges(spark):
    rows = list(site(60, random.Random(3)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found = pd.extract_pages(spark.createDataFrame(rows, DDL))
            assert {r.page_id: (r.text, r.n_shared) for r in found.collect()} == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("parts", [1, 13])
def test_copies_meet_the_nearest_different_page(spark, parts):
    """Long template over short texts, in groups of copies that differ in an advert at most, over many ranges."""
    menu = "".join(f"<li>entry {k} of the long menu</li>" for k in range(40))
    rows = []
    for i in range(90):
        body = f"short text number {i // 15} of the host"
        ad = f"<div class='ad'>advert {i % 2}</div>"
        rows.append((i, f"https://h/{i:03}", f"<ul>{menu}</ul>{ad}<div>{body}</div>" if i % 15 != 7 else None, "h"))
    near = "The same words in a long text. " * 20
    for i, line in enumerate(("written on the third of May", "written on the fourth of June", None)):
        text = f"<div>{near}</div><div>{line}</div>" if line else "<div>All else is different here</div>"
        rows.append((100 + i, f"https://n/{i}", f"<div>Welcome to the host</div>{text}", "n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.page_id: r.text for r in pd.extract_pages(spark.createDataFrame(rows, DDL)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i in range(90):
        assert got[i] == ("" if i % 15 == 7 else f"short text number {i // 15} of the host")
    assert near.strip() in got[101] and "Welcome" not in got[101]


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [
        (1, None, None, None), (None, "http://[bad", "<p>x", None), (3, "https://a/b", "", "c"),
        (4, "https://a/c", long, "c"), (5, "https://m/x", "<p>same</p>", "c"), (6, "https://m/x#top", "<p>same</p>", "c"),
        (6, "https://m/x#top", "<p>same</p>", "c"),
    ]
    found = pd.extract_pages(spark.createDataFrame(rows, DDL)).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and got[1] == "" and got[None] == "x" and got[3] == ""
    assert got[4].count("\n") == 19_999 and got[5] == got[6] == "same"
    assert pd.extract_pages(spark.createDataFrame([], DDL)).count() == 0


def test_articles_of_the_tables_come_out_whole(spark):
    """The pages of the tables have one article each: the blocks between its tags."""
    got = {r.page_id: r.text for r in pd.op1_page_diff(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = p.html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1|br)>", inner.replace("<b>", ""))
        lines = [" ".join(html.unescape(x).split()) for x in parts]
        assert got[p.page_id] == "\n".join(x for x in lines if x)


@pytest.mark.parametrize("body", [
    "<nav>Menu</nav><div>{0}</div>", "<div><h1>Title</h1><p>{0}</p></div>", "<article>{0}</article><div class='menu'>Menu</div>",
    "<div><form><main>{0}</main></form></div><footer>End</footer>",
])
def test_a_form_around_the_page_is_none(body):
    text = "The body of the page, which no form holds."
    html = f"<html><body><form id='aspnetForm' action='/'><input type=hidden>{body.format(text)}<form class='x'>Your name</form></form></body></html>"
    kept = [t for kind, t in pd.blocks_of(html.encode()) if kind != pd.DROP]
    assert text in kept and "Menu" not in kept and "End" not in kept


def test_forms_of_a_page_go():
    html = "<body><form><p>Search here</p></form><article><p>Text.</p><form role=form><p>Say something</p></form></article><div role='form'>Sign in</div></body>"
    assert [t for kind, t in pd.blocks_of(html.encode()) if kind != pd.DROP] == ["Text."]
