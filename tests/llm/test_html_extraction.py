"""Main texts of pages: the parser on broken pages, the tree against a plain version, and whole sites with known articles."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallymatch.llm import html_extraction
from tallymatch.llm.html_blocks import branches_and_blocks
from tallymatch.llm.html_extraction import host_of, low_nodes, main_texts, node_importance, page_pieces, page_statistics

SCHEMA = "page_id long, url string, html string, host string, text string, key int, node long, ids string"


def alone(html):
    return html_extraction.remaining(page_pieces(None, html), frozenset())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just  words &amp; more &#233;&eacute &nbsp;x", "just words & more éé x"),
        ("<p>a<p>b<br>c</p>d", "a b c d"),
        ("<p>one<b>two</b><i> three</i>", "onetwo three"),
        ("<title>T</title><style>p{}</style><script>var t='</p>';</script><p>x", "x"),
        ("<SCRIPT>if (a < b) '<p>no</p>'</SCRIPT ><p>x", "x"),
        ("<script>never closed <p>x", ""),
        ("<!-- <p>no</p> --><p>yes<!-->also", "yesalso"),
        ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>x</p><p clas", "x"),
        ("<p>a</div></section>b", "a b"),
        ('<p title="a > b">x</p><p title=\'"\'>y', "x y"),
        ("<nav><a>menu</a></nav><p>x</p><footer>f</footer>", "x"),
        ("<div class='top nav-bar'>menu</div><p>x", "x"),
        ("<div id=cookieNotice>we use</div><p>x", "x"),
        ("<p class=ad>buy<p>x", "x"),
        ("<p>x <span class='share'>share me</span> y", "x y"),
        ("<p hidden>no</p><p style='color:red; display: none'>no</p><p>x", "x"),
        ("<div>out</div><article><header><h1>T</h1></header><p>x</p><section class=comments><p>first!</p></section></article>", "T x"),
        ("<article><h1>T</h1>x</article><article class=comment>first!</article>", "T x"),
        ("<main><p>a</p><aside>b</aside><div role=navigation>c</div></main><div>d</div>", "a"),
        ("<form id=all><div>menu</div><article>x</article></form>", "x"),
        ("<div class='with-sidebar'><article>x</article><div class=sidebar>y</div></div>", "x"),
        ("<table><tr><td>a<td>b</table>", "a b"),
        ("<aside><article>teaser</article></aside><p>x", "x"),
        ("<body>&lt;b&gt; x &amp;amp;</body></html>", "<b> x &amp;"),
        ("<article>a   b\tc</article>", "a b c"),
        ("<nav><ul><li>never closed", ""),
    ],
)
def test_pages_by_their_marks(html, text):
    assert alone(html) == text


def test_awkward_pages_end():
    for html in ("<" * 50_000, "<div>" * 20_000 + "x", "<a href='" * 2_000, "</p>" * 50_000, "&" * 50_000, "<p class=a" * 5_000, "<!--" * 20_000, '="' * 50_000, "<article>" * 5_000 + "x" * 1_000_000):
        branches, blocks = branches_and_blocks(html)
        assert isinstance(alone(html), str) and len(branches) <= 20_001


def test_hosts(spark):
    urls = ["https://A.example.org/x?y=//z", "http://u:p@b.example:80/", "//c.example", "ftp://[::1]:8/", "no host", "", None, "http:///x", " HTTP://D.example#f"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h")).collect()]
    assert got == ["a.example.org", "b.example", "c.example", "[::1]", None, None, None, None, "d.example"]


def plain_importance(pages, gamma=0.9):
    """The tree once more: per node, importance from lists of its pages."""
    seen, nodes = set(), defaultdict(list)
    for host, html in pages:
        stats = list(page_statistics(host, html))
        by_node = defaultdict(lambda: [None, Counter()])
        for node, style, item, page, n in stats:
            if style:
                by_node[node][0] = item
            else:
                by_node[node][1][item] += n
        for node, (style, texts) in by_node.items():
            key = (node, style, frozenset(texts.items()), page)
            if key not in seen:
                seen.add(key)
                nodes[node].append((style, texts))
    entropy = lambda counts, base: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(base)
    out = {}
    for node, found in nodes.items():
        m, styles = len(found), Counter(s for s, _ in found)
        if m == 1:
            out[node] = (1, 1.0)
            continue
        texts = {t for _, counts in found for t in counts}
        content = 1 - sum(entropy([c[t] for _, c in found if t in c], m) for t in texts) / len(texts)
        weight = gamma ** len(styles)
        out[node] = (m, (1 - weight) * entropy(styles.values(), m) + weight * content)
    return out


def site(rng, n=40, host="h.example", copies=0):
    """Pages without any mark: divs by place alone, with a menu, boilerplate of a few kinds, and one true text each."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    menu, legal, promos = "".join(f"<a href=/{i}>{word()}</a> " for i in range(6)), " ".join(word() for _ in range(30)), [" ".join(word() for _ in range(12)) for _ in range(3)]
    made = []
    for i in range(n):
        body = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 6))] if not copies or i >= copies else made[0][2] if i else ["the text that is copied", "and its second part " * 3]
        html = f"<html><body><div><div>{menu}</div></div><div><div>{''.join(f'<p>{p}</p>' for p in body)}</div><div>{promos[i % 3]}</div></div><div>{legal}</div></body></html>"
        made.append((f"http://{host}/{i}", html, body))
    return made


def test_tree_against_a_plain_version(spark):
    rng = random.Random(3)
    pages = [("h1", html) for _, html, _ in site(rng, 20)] + [("h2", html) for _, html, _ in site(rng, 12)] + [("h3", "<article><p>a</p></article><nav><a>m</a></nav>")]
    pages += pages[:3]
    rows = [r for host, html in pages for r in page_statistics(host, html)]
    got = {r.node: (r.pages, r.importance) for r in node_importance(spark.createDataFrame(rows, html_extraction.STATISTICS)).collect()}
    want = plain_importance(pages)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    low = {r.node for r in low_nodes(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert low == {k for k, (m, x) in want.items() if m >= 8 and x < 0.4} and low


@pytest.mark.parametrize("sent", [html_extraction.SENT, 0])
def test_sites_without_marks(spark, sent):
    """The tree alone finds menus, promotions and legal notes; both ways of removing give the same."""
    rng = random.Random(4)
    made = site(rng, 60) + site(rng, 40, "other.example") + site(rng, 80, "copies.example", copies=30)
    marked = [("http://m.example/", "<nav>m</nav><article><h1>T</h1><p>x &amp; y</p></article>", ["T", "x & y"]), (None, "<p>z</p>", ["z"]), ("http://e.example", None, []), ("http://e.example", "", []), (None, "<nav>m</nav>", [])]
    rows = [(i, u, h, "clash", "clash", 1, 2, "clash") for i, (u, h, _) in enumerate(made + marked)]
    df = spark.createDataFrame(rows + rows[-4:] + [(None, *rows[0][1:])], SCHEMA).repartition(4)
    got = main_texts(df, sent=sent)
    assert got.columns == ["page_id", "url", "text"]
    want = Counter((str(i), u, " ".join(" ".join(b).split())) for i, (u, _, b) in [*enumerate(made + marked), *list(enumerate(made + marked))[-4:], ("None", made[0])])
    assert Counter((str(r.page_id), r.url, r.text) for r in got.collect()) == want
    assert main_texts(df.limit(0), sent=sent).count() == 0


def test_a_host_of_copies_keeps_its_article(spark):
    """Near copies of one article in place of many: all is alike, so the branch with most text stays."""
    body = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"http://h.example/{i}", f"<div>menu of the site</div><div><p>{body} {i}</p><p>{body}</p></div><div>legal</div>") for i in range(12)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(body in r.text for r in got)


def test_small_hosts_keep_all(spark):
    """Seven pages that say the same beside their texts are no evidence yet."""
    made = site(random.Random(5), 7)
    got = main_texts(spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(made)], "page_id long, url string, html string")).collect()
    assert all(len(r.text.split()) > len(" ".join(made[r.page_id][2]).split()) for r in got)


def test_a_very_long_page(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, "http://h.example", f"<nav>m</nav><article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert main_texts(df).first().text == text
