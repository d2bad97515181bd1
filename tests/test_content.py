"""Main content of web pages against a tree of the standard library's parser."""

import hashlib
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from foliospark.plans import QUERIES
from foliospark.session import load
from foliospark.sources import content
from foliospark.sources.markup import DROPPED


class Tree(HTMLParser):
    """Nodes as [name, children]; texts as str, joined until a tag or a comment, even an end tag of nothing."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in content.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        self.open[-1][1].append(["!", []])

    def handle_data(self, data):
        inside = self.open[-1][1]
        if inside and isinstance(inside[-1], str):
            inside[-1] += data
        else:
            inside.append(data)

    def handle_comment(self, data):
        self.open[-1][1].append(["!", []])


def walked(node):
    yield node
    for child in node[1]:
        if not isinstance(child, str):
            yield from walked(child)


def pruned(node):
    node[1] = [c if isinstance(c, str) else pruned(c) for c in node[1] if isinstance(c, str) or c[0] not in [*DROPPED, "template"]]
    return node


def texts(node):
    for child in node[1]:
        yield from [child] if isinstance(child, str) else texts(child)


def expected(html: str, url: str):
    root = pruned(Tree(html).root)
    first = lambda name: next((n for n in walked(root) if n[0] == name), None)
    head = first("title")
    main = next(filter(None, map(first, content.MAIN)), root)
    lines = (line.strip() for text in texts(main) for line in text.splitlines())
    return (head[1][0].strip() if head and len(head[1]) == 1 and isinstance(head[1][0], str) else url), "\n".join(filter(None, lines))


CASES = [
    "<body><div><nav>a<nav>b</nav>c</nav>d</div>e</body>",
    "<body>a<form>b<div>c<form>d</form></div>e</form>f<header>g<header>h</header>i</header>j",
    "<main>m<article>first</article></main><article>second</article>",
    "<nav><article>no</article></nav><main>yes <b>bold</b>\nline</main>",
    "<body><article>x<p>y<div>z</article>out",
    "<body><div><aside>never closed</div>seen",
    "<body></div>a</span></p>b<br/>c<br>d<img src='x>y'>e",
    "<nav/>after an empty element<p class=\"a>b\">quoted",
    "<title> T &amp; U </title>no body &lt;b&gt; &copy; &#65;&#x42; &nbsp; x",
    "<title>one</title><title>two</title><body>t",
    "<header><title>gone</title></header><body>u",
    "<body>1 < 2 && 3 <4 <!-- <nav> -->after",
    "<body><script>if (a < b) '</nav>'</script>s<style>p{}</style>t",
    "<BODY><NaV>x</nAv>Y</BODY>Z",
    "<body>a b \x0b c 　<p> </p>é\U0001f600</body>",
    "<template><article>hid</article></template><body>w",
    "<article></article><main>main text</main>",
    "",
    "plain",
]


def test_nested_pages(spark):
    rows = [(i, h, f"u{i}") for i, h in enumerate(CASES)] + [(-1, None, "n")]
    df = spark.createDataFrame(rows, "content_id int, html string, url string")
    got = {r.content_id: r for r in content.contents(df).select("content_id", "content").collect()}
    assert got[-1].content is None
    for i, html in enumerate(CASES):
        assert tuple(got[i].content) == expected(html, f"u{i}"), html


def test_open_ends(spark):
    """Comments and scripts that nothing ends go up to the end of the page."""
    rows = [("a<!-- b <p>c", "a"), ("a<script>b</p>c", "a"), ("a<p title='b", "a")]
    got = content.contents(spark.createDataFrame(rows, "html string, want string").withColumn("url", F.lit("u"))).select("content.text", "want").collect()
    assert all(r.text == r.want for r in got), got


def test_references(spark):
    rows = [("&eacute;&copy 2020 AT&T; &bogus; &#128; &#x1F600; &#xD800; &#99999999999; & &; &#", "é© 2020 AT&T &bogus € \U0001f600 � � & &; &#"), ("none", "none"), ("", "")]
    got = spark.createDataFrame(rows, "t string, w string").select(content.unescaped(F.col("t")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got), got


def test_pages_of_text(spark):
    text = "a" * 2999 + "\U0001f600" + " " * 3000 + " b c "
    (row,) = spark.createDataFrame([(text,)], "t string").select(content.paged(F.col("t")).alias("p")).collect()
    assert [tuple(p) for p in row.p] == [(1, "a" * 2999 + "\U0001f600", 1), (2, "b c", 2)]
    assert spark.createDataFrame([("",)], "t string").select(content.paged(F.col("t")).alias("p")).collect()[0].p == []


def test_whole_table(spark, sf_dir):
    want = []
    for r in load(spark, sf_dir, "pages").collect():
        title, text = expected(r.html, r.url)
        parts = [text[i : i + content.PAGE].strip() for i in range(0, len(text), content.PAGE)]
        want += [(r.page_id, title, n, hashlib.md5(p.encode()).hexdigest(), len(p.split())) for n, p in enumerate(filter(None, parts), 1)]
    got = sorted(map(tuple, QUERIES["page_contents"](spark, sf_dir).collect()))
    assert len(got) > 0 and got == sorted(want)


@pytest.mark.parametrize("unit", ["<p>x &amp; y</p>", "<div><a href='q'>z</a>"])
def test_long_pages(spark, unit):
    """Ten times the tags, closed or never closed, in far less than a hundred times the time."""
    took = []
    for n in (200, 4000, 40000):
        df = spark.createDataFrame([(unit * n, "u")], "html string, url string")
        start = time.time()
        (row,) = content.contents(df).select(F.length("content.text").alias("n")).collect()
        took.append(time.time() - start)
        assert row.n == len(expected("<p>x &amp; y</p>", "u")[1] if "amp" in unit else "z") * n + n - 1
    assert took[2] < 40 * max(took[1], 0.5)
