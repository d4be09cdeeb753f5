"""Main text of web pages by site style trees: what a site's pages share in look or text carries little importance and
goes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, read, text_batches
from lumora.llm.htmltree import Page, parse
from lumora.llm.urls import host_of

#: Least different pages of a site that share a style node before it is judged, the importance below which a branch goes,
#: and the weight of content against presentation.
LEAST_PAGES, LOW, GAMMA = 3, 0.6, 0.5
#: What the words in an element's names leave of its importance: strong ones, weak ones outside the article, weak ones in
#: it; and what standing beside an article or main element leaves: of a judged node, of another.
STRONG, WEAK_OUTSIDE, WEAK_INSIDE, BESIDE, BESIDE_UNJUDGED = 0.5, 0.5, 0.75, 0.75, 0.5
PAGES, LOOKS, CONTENT = 0, 1, 2
#: Judged nodes (some 50 bytes each) that are broadcast at most, and pages of a host in a group beyond that.
BROADCAST_NODES, GROUP = 500_000, 1000

Nodes = dict[int, tuple[float, float]]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def plain_blocks(page: Page) -> list[tuple[int, str]]:
    """The page's blocks (where it has article or main elements, those in them) that are not dropped and stand in no element
    with a strong word in its names; all of them, if none is left. Names of html and body, of what holds an article or
    main element, of one with half of their text, and elsewhere of what holds nine tenths of the page do not count."""
    es = page.elements
    blocks = [(i, t) for i, t in page.blocks if not es[i].dropped]
    beside = any(es[i].main for i, _ in blocks)
    blocks = [(i, t) for i, t in blocks if es[i].main or not beside]
    size, holds = [0] * len(es), [False] * len(es)
    for i, t in blocks:
        size[i] += len(t)
    for i in range(len(es) - 1, 0, -1):
        size[es[i].parent] += size[i]
        holds[es[i].parent] |= holds[i] or es[i].main
    marked = [False] * len(es)
    for i, e in enumerate(es[1:], 1):
        outer = e.main and not es[e.parent].main
        large = 2 * size[i] >= size[0] if outer else not beside and 10 * size[i] >= 9 * size[0]
        silent = e.tag in ("html", "body") or large or (holds[i] and not e.main)
        marked[i] = marked[e.parent] or (e.doubt == 2 and not silent)
    return [(i, t) for i, t in blocks if not marked[i]] or blocks


def article_of(page: Page) -> list[bool]:
    """For each element whether it belongs to the page's article: in an article or main element; where a page has none,
    in the innermost element with half of the text of ``plain_blocks``, or around it if that is a single block."""
    es = page.elements
    if any(es[i].main for i, _ in page.blocks if not es[i].dropped):
        return [e.main for e in es]
    size = [0] * len(es)
    for i, t in plain_blocks(page):
        size[i] += len(t)
    own = size.copy()
    for i in range(len(es) - 1, 0, -1):  # children stand behind their parents
        size[es[i].parent] += size[i]
    at = 0
    for i in range(1, len(es)):
        if es[i].parent == at and 2 * size[i] >= size[0] > 0:
            at = i
    if own[at] == size[at] and at:
        at = es[at].parent
    inside = [False] * len(es)
    for i, e in enumerate(es):
        inside[i] = i == at or (i > 0 and inside[e.parent])
    return inside


def _features(page: Page) -> set[tuple[int, int, int]]:
    """(path, kind, feature) of a page's elements that are not dropped: that it has the path, the sequence of its
    children, the texts directly in it."""
    out = set()
    for e in page.elements[1:]:
        if not e.dropped:
            out.add((e.path, PAGES, 0))
            out.add((e.path, LOOKS, _hash("\n".join(e.children))))
    for i, text in page.blocks:
        if i and not page.elements[i].dropped:
            out.add((page.elements[i].path, CONTENT, _hash(text)))
    return out


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, m, presentation, content) of the style nodes of ``pages`` (host, html) that at least ``least_pages``
    different pages share.

    A node merges the elements that a host's pages have under the same chain of tags, classes and ids. Over its m
    pages, presentation importance is the entropy of its children's sequences to base m; content importance is 1
    less the mean entropy of its texts, where one on c pages has log c to base m, and 1 for a node without text. Pages
    of a host whose articles have the same text count once, so copies do not speak against what they hold. Rows
    are shuffled by host, node and feature, so one host's pages never meet in one task. Pages without a host belong
    to no site.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for host, markup in zip(b["host"], b["html"]):
                page = parse(markup)
                inside = article_of(page)
                key = _hash("\n".join(t for i, t in page.blocks if inside[i] and not page.elements[i].dropped))
                rows |= {(host, *f, key) for f in _features(page)}
            yield pd.DataFrame(list(rows), columns=["host", "path", "kind", "feature", "page"])

    rows = pages.where("host <> ''").select("host", "html").mapInPandas(run, "host string, path long, kind int, feature long, page long")
    counts = rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    log, kind = F.log(F.col("n")), F.col("kind")
    nodes = counts.groupBy("host", "path").agg(
        F.max(F.when(kind == PAGES, F.col("n"))).alias("m"),
        F.sum(F.when(kind == LOOKS, F.col("n"))).alias("k"),
        F.sum(F.when(kind == LOOKS, F.col("n") * log)).alias("looks"),
        F.sum(F.when(kind == CONTENT, log)).alias("texts"),
        F.count_if(kind == CONTENT).alias("l"),
    )
    # a page that repeats a node may add several sequences: their shares are of all k
    looks = F.greatest((F.log("k") - F.col("looks") / F.col("k")) / F.log("k"), F.lit(0.0))
    content = F.when(F.col("l") > 0, 1 - F.col("texts") / F.col("l") / F.log("m")).otherwise(F.lit(1.0))
    return nodes.where(F.col("m") >= max(2, least_pages)).select("host", "path", "m", looks.alias("presentation"), content.alias("content"))


def extract(page: Page, nodes: Nodes | None, names: bool = True) -> str:
    """The page's article: its blocks without dropped elements and without branches of low importance.

    ``nodes`` has (presentation, content) importance by path of the site's judged nodes. A block's importance is
    (1 - GAMMA) times presentation plus GAMMA times content. Inside the article presentation counts as 1; elsewhere it is
    the highest of the element and those around it, up to where the article branches off. A block of a node that is
    not judged has 1. Names of an element and those around it, but for such as hold half of the article, and the place
    beside the article lower it (not if ``names`` is false). A branch's importance
    is the mean over its text, by length, without branches of its own that go; below LOW it goes, unless it holds the
    article.
    """
    es, nodes = page.elements, nodes or {}
    blocks = [(i, t) for i, t in page.blocks if not es[i].dropped]
    inside = article_of(page)
    beside = any(es[i].main for i, _ in blocks)
    holds = inside.copy()  # the article and all around it
    for i in range(len(es) - 1, 0, -1):
        holds[es[i].parent] |= holds[i]
    own_text = [0] * len(es)  # of the article
    for i, t in plain_blocks(page):
        own_text[i] += len(t) * inside[i]
    for i in range(len(es) - 1, 0, -1):
        own_text[es[i].parent] += own_text[i]
    shown, doubt = [0.0] * len(es), [0] * len(es)
    for i in range(1, len(es)):
        e = es[i]
        doubt[i] = 0 if 2 * own_text[i] >= own_text[0] > 0 else max(e.doubt, doubt[e.parent])
        own = nodes.get(e.path, (0.0, 1.0))[0]
        shown[i] = 1.0 if inside[i] else own if holds[e.parent] else max(own, shown[e.parent])
    size, mass, worth = [0] * len(es), [0.0] * len(es), []
    for i, t in blocks:
        e = es[i]
        value = (1 - GAMMA) * shown[i] + GAMMA * nodes[e.path][1] if e.path in nodes else 1.0
        if names:
            value *= (1.0, WEAK_INSIDE if inside[i] else WEAK_OUTSIDE, STRONG)[doubt[i]]
            if beside and not inside[i]:
                value *= BESIDE if e.path in nodes else BESIDE_UNJUDGED
        worth.append(value)
        size[i] += len(t)
        mass[i] += len(t) * value
    stays = [h and not inside[i] for i, h in enumerate(holds)]
    gone = [False] * len(es)
    for i in range(len(es) - 1, 0, -1):  # what goes does not speak against what holds it
        gone[i] = not stays[i] and mass[i] < LOW * size[i]
        if not gone[i]:
            size[es[i].parent] += size[i]
            mass[es[i].parent] += mass[i]
    for i in range(1, len(es)):
        gone[i] |= gone[es[i].parent]
    # text directly in what is around the article has no branch of its own
    return " ".join(t for (i, t), value in zip(blocks, worth) if not gone[i] and not (stays[i] and value < LOW))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. A null url belongs to no site, so only the page's own markup decides.
    Judged nodes are broadcast up to BROADCAST_NODES, once to an executor; beyond, a host's pages and nodes meet in
    groups of some GROUP pages, each with one copy of the nodes.
    """
    rows = text_batches(pages).select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of(F.col("url")))
    judged = checkpointed(style_tree(rows, least_pages))
    schema = "page_id long, url string, text string, n_chars long"

    def texts(b: pd.DataFrame, nodes: list[Nodes | None]) -> pd.DataFrame:
        text = [extract(parse(markup), n) for markup, n in zip(b["html"], nodes)]
        return pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    if judged.count() <= BROADCAST_NODES:
        sites: dict[str, Nodes] = {}
        for r in judged.collect():
            sites.setdefault(r["host"], {})[r["path"]] = (r["presentation"], r["content"])
        shared = pages.sparkSession.sparkContext.broadcast(sites)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield texts(b, [shared.value.get(h) for h in b["host"]])

        return rows.mapInPandas(run, schema)

    def together(b: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        nodes = dict(zip(n["path"], zip(n["presentation"], n["content"])))
        return texts(b, [nodes] * len(b))

    big = rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    big = F.broadcast(big.select(F.col("host").alias("_h"), "parts"))  # one row per GROUP pages at most
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(big, rows["host"] == F.col("_h"), "left").withColumn("part", F.pmod(F.xxhash64("page_id", "html"), parts).cast("int")).drop("_h", "parts")
    there = judged.join(big, judged["host"] == F.col("_h"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_h", "parts")
    return dealt.groupBy("host", "part").cogroup(there.groupBy("host", "part")).applyInPandas(together, schema)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
