"""Main texts of web pages by a style tree of each site.

All pages of a host are merged into one tree: a node for each branch by its presentation path, with how its pages style its
children and which texts its pages have below it. A node whose pages look alike and say the same is of low importance, and
branches at such nodes go from every page. Where a page says itself what is none of its article, it is believed; what it says
is the article goes through the tree as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .html_blocks import NOISE, branches_and_blocks, candidates

STATISTICS = "node long, style boolean, item long, page long, n int"
PIECES = "key long, pieces array<struct<nodes: array<long>, text: string, main: boolean>>"
#: Nodes of low importance, at 8 bytes each, that are sent to all workers at most; more are joined to the pages.
SENT = 1_000_000


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def page_statistics(host: str, html: str) -> Iterator[tuple[int, bool, int, int, int]]:
    """What a page gives to its site's tree: for each branch its children's style, and how often each text is in or below it.

    All that an article element has is one text: its pages tell articles apart as well by the whole as by each paragraph.
    """
    branches, blocks = branches_and_blocks(html)
    texts = [(i, _number(text)) for i, text in blocks]
    page = _number(" ".join(text for i, text in blocks if max(branches[i].noise, branches[i].outer) < NOISE))
    below: list[Counter[int]] = [Counter() for _ in branches]
    for i, number in texts:
        while i > 0:
            below[i][number] += 1
            i = branches[i].parent
    for branch, counts in zip(branches[1:], below[1:], strict=True):
        if counts:
            node = _number(f"{host}\0{branch.path}")
            yield node, True, _number("\0".join(branch.children)), page, 1
            if branch.region == "article":
                counts = {(sum(number * n for number, n in counts.items()) & (1 << 64) - 1) - (1 << 63): 1}
            for number, n in counts.items():
                yield node, False, number, page, n


def page_pieces(host: str | None, html: str) -> list[tuple[list[int], str, bool]]:
    """A page's texts in order, each with the nodes that the tree may remove it by, and whether it is in the branch with most
    text of its own. No nodes where the page has no host: marks say what may be the article's, and the tree is asked of that too."""
    branches, blocks = branches_and_blocks(html)
    found = candidates(branches, blocks)
    if host is None or not found:
        return [([], text, True) for _, text in found]
    sizes: Counter[int] = Counter()
    for i, text in found:
        sizes[i] += len(text)
    main = max(sizes, key=lambda i: (sizes[i], -i))
    nodes: dict[int, list[int]] = {0: []}
    for i, branch in enumerate(branches[1:], 1):
        nodes[i] = [*nodes[branch.parent], _number(f"{host}\0{branch.path}")]
    return [(nodes[i], text, i == main) for i, text in found]


def remaining(pieces: list[tuple[list[int], str, bool]], removed: frozenset[int]) -> str:
    """The text without branches at removed nodes; a page that would lose all of it keeps the branch with most text."""
    return " ".join([text for nodes, text, _ in pieces if removed.isdisjoint(nodes)] or [text for _, text, main in pieces if main])


def node_importance(statistics: DataFrame, gamma: float = 0.9) -> DataFrame:
    """node, pages and importance: (1 - gamma^l) * presentation + gamma^l * content for a node of l styles.

    Presentation is the entropy of the styles over the node's pages; content is one less the mean, over the node's distinct
    texts, of the entropy of each text over the pages; both to the base of the number of pages. Pages that say the same are
    one page, so copies of an article don't make it look like a part of the site. A node of one page has importance 1.
    """
    once = statistics.groupBy("node", "style", "item", "page").agg(F.max("n").alias("n"))
    items = once.groupBy("node", "style", "item").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("spread"))
    style, text = F.col("style"), ~F.col("style")
    sums = items.groupBy("node").agg(
        F.sum(F.when(style, F.col("k"))).alias("pages"),
        F.count_if(style).alias("styles"),
        F.sum(F.when(style, F.col("k") * F.ln("k"))).alias("alike"),
        F.count_if(text).alias("texts"),
        F.sum(F.when(text, F.ln("total") - F.col("spread") / F.col("total"))).alias("entropy"),
    )
    base, weight = F.ln("pages"), F.pow(F.lit(gamma), F.col("styles"))
    presentation = (base - F.col("alike") / F.col("pages")) / base
    content = 1 - F.col("entropy") / base / F.col("texts")
    return sums.select("node", "pages", F.when(F.col("pages") > 1, (1 - weight) * presentation + weight * content).otherwise(1.0).alias("importance"))


def low_nodes(pages: DataFrame, least_pages: int = 8, threshold: float = 0.4) -> DataFrame:
    """Nodes of importance below the threshold, of least_pages different pages or more. pages: host, html."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = [r for host, html in zip(*map(pa.Array.to_pylist, b.columns), strict=True) for r in page_statistics(host, html)]
            if rows:
                node, style, item, page, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(style), pa.array(item, pa.int64()), pa.array(page, pa.int64()), pa.array(n, pa.int32())], names=["node", "style", "item", "page", "n"])

    statistics = pages.where(F.col("host").isNotNull() & (F.col("html") != "")).select("host", "html").mapInArrow(gather, STATISTICS)
    return node_importance(statistics).where((F.col("pages") >= least_pages) & (F.col("importance") < threshold)).select("node")


def main_texts(df: DataFrame, id_cols: Iterable[str] = ("page_id", "url"), url_col: str = "url", html_col: str = "html", least_pages: int = 8, threshold: float = 0.4, sent: int = SENT) -> DataFrame:
    """id_cols and text, the article of each page of df: its blocks in page order, joined by a space.

    Null and empty pages, and those with nothing but noise, have an empty text. Pages without a host are taken by their
    marks alone; a page that the tree would leave nothing of keeps its branch with most text. Repeated rows are kept; columns of df other than those named are not looked at; an empty table gives no rows.
    Pages are parsed twice: once for the tree, of which only sums by node are shuffled, and once for the texts. Where no more
    than sent nodes are low, they go to all workers and no text is shuffled; else pages' nodes are joined to them.
    """
    spark, ids = df.sparkSession, list(id_cols)
    pages = df.select(F.struct(*ids).alias("ids"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    low = kept(low_nodes(pages, least_pages, threshold), "low-nodes")
    if low.count() > sent:
        return _joined(pages, low, ids)
    nodes = spark.sparkContext.broadcast(np.array([r.node for r in low.collect()], np.int64).tobytes())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed = _set_of(nodes.value)
        for b in slices(batches, 2):
            texts = [remaining(page_pieces(host, html), removed) for host, html in zip(*map(pa.Array.to_pylist, b.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["ids", "text"])

    schema = pages.select("ids", F.lit("").alias("text")).schema
    return pages.mapInArrow(extract, schema).select(*(F.col("ids")[c].alias(c) for c in ids), "text")


@lru_cache(maxsize=2)
def _set_of(nodes: bytes) -> frozenset[int]:
    return frozenset(np.frombuffer(nodes, np.int64).tolist())


def _joined(pages: DataFrame, low: DataFrame, ids: list[str]) -> DataFrame:
    """The same by joins: pages' pieces as a table, and for each page which of its nodes are low."""
    keyed = kept(pages.withColumn("key", F.monotonically_increasing_id()), "pages")

    kind = pa.list_(pa.struct([("nodes", pa.list_(pa.int64())), ("text", pa.string()), ("main", pa.bool_())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            pieces = [[dict(zip(("nodes", "text", "main"), x, strict=True)) for x in page_pieces(host, html)] for host, html in zip(*map(pa.Array.to_pylist, b.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, kind)], names=["key", "pieces"])

    pieces = kept(keyed.select("key", "host", "html").mapInArrow(cut, PIECES), "pieces")
    asked = pieces.select("key", F.explode(F.array_distinct(F.flatten("pieces.nodes"))).alias("node"))
    found = asked.join(low, "node").groupBy("key").agg(F.collect_set("node").alias("removed"))
    left = F.filter("pieces", lambda x: F.col("removed").isNull() | ~F.arrays_overlap(x["nodes"], F.col("removed")))
    left = F.when(F.size(left) > 0, left).otherwise(F.filter("pieces", lambda x: x["main"]))
    texts = pieces.join(found, "key", "left").select("key", F.array_join(F.transform(left, lambda x: x["text"]), " ").alias("text"))
    return keyed.select("ids", "key").join(texts, "key").select(*(F.col("ids")[c].alias(c) for c in ids), "text")
