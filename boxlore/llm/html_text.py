"""Main text of web pages by wrapper induction.

1. Every page becomes a skeleton (its tree of block elements, repeated neighbours folded)
   and one row of hashes and lengths per text block; no text moves.
2. The commonest skeleton of a host is its reference.  Every page of the host is aligned
   with it by simple tree matching; a block that stands at the same reference node with
   the same text on nearly all different pages of the host is template, and the node that
   holds most varying text outside links is the content slot.
3. Each page meets its host's wrapper and gives the text of its content: the article or
   main element, else the subtree around the slot, else the element with most text of its
   own; without template blocks and without what its element, class, id or role marks as
   menu, header, footer, sidebar, notice, advert, form or comment.

Two pages count as different when their three longest blocks differ, so copies of one
page never make its article a template.

Defined results: null html gives the empty text; pages without host have no wrapper and
are read by step 3 alone; repeated rows are extracted each; broken markup is read as
browsers do for unclosed paragraphs, list items, cells and headings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from boxlore.llm.common import small_batches, written
from boxlore.llm.html_tree import HEADINGS, NO_TEXT_TAGS, NO_TEXT_WORDS, Node, Page, align, parents

#: a template block stands on this share of a host's different pages, and on so many at least
TEMPLATE_SHARE = 0.9
#: a page without article and main: an element with this share of its running text is never beside the content
MOST_TEXT = 0.8
#: articles that hold less than this share of the text of main are teasers in it
TEASER = 0.5
TEMPLATE_PAGES = 5


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=4096)
def tree_of(written_tree: str) -> tuple:
    as_tuple = lambda node: (node[0], tuple(map(as_tuple, node[1])))
    return as_tuple(json.loads(written_tree))


def describe(pages: DataFrame) -> DataFrame:
    """(host, skeleton, longest, blocks) per page, from (host, html)."""
    block = pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(block)]
    names = ["host", "skeleton", "longest", "blocks"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for name, source in zip(*(column.to_pylist() for column in batch.columns)):
                page = Page(source)
                longest = "\n".join(sorted((text for _, text, _ in page.blocks), key=lambda t: (-len(t), t))[:3])
                blocks = [
                    {"node": n.index, "hash": digest(text), "chars": len(text), "linked": linked} for n, text, linked in page.blocks
                ]
                rows.append((name, json.dumps(page.skeleton), digest(longest), blocks))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return pages.select("host", "html").mapInArrow(
        work, "host string, skeleton string, longest long, blocks array<struct<node: int, hash: long, chars: long, linked: long>>")


def _aligned(described: DataFrame, references: DataFrame) -> DataFrame:
    """(host, node, hash, longest, chars, linked) per block that has a node in its host's reference."""
    names = ["host", "node", "hash", "longest", "chars", "linked"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for page in batch.to_pylist():
                numbers = align(tree_of(page["skeleton"]), tree_of(page["reference"]))
                rows += [
                    (page["host"], numbers[b["node"]], b["hash"], page["longest"], b["chars"], b["linked"])
                    for b in page["blocks"] if b["node"] in numbers
                ]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    met = described.join(references, "host").select("host", "skeleton", "reference", "longest", "blocks")
    return met.mapInArrow(work, "host string, node int, hash long, longest long, chars long, linked long")


def induce(pages: DataFrame) -> DataFrame:
    """One wrapper per host: reference, template (blocks as node and hash) and slot (node), from (host, html).

    A host's template has few entries, as each must stand on nearly all of its pages.
    """
    described = written(describe(pages.where("host != ''")), "page-skeletons")
    references = written(
        described.groupBy("host", "skeleton").count().groupBy("host")
        .agg(F.max(F.struct("count", "skeleton"))["skeleton"].alias("reference")), "host-references",
    )
    different = described.groupBy("host", "longest").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    blocks = _aligned(described, references).groupBy("host", "node", "hash", "longest").agg(
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    texts = blocks.groupBy("host", "node", "hash").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    judged = texts.join(different, "host").withColumn(
        "constant", (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= F.col("pages") * TEMPLATE_SHARE))
    nodes = judged.groupBy("host", "node").agg(
        F.sum(F.when(~F.col("constant"), F.col("chars") - 2 * F.col("linked")).otherwise(0)).alias("varying"),
        F.collect_list(F.when(F.col("constant"), F.struct("node", "hash"))).alias("template"),
    )
    hosts = nodes.groupBy("host").agg(
        F.max(F.struct("varying", -F.col("node")))["varying"].alias("most"),
        (-F.max(F.struct("varying", (-F.col("node")).alias("back")))["back"]).alias("slot"),
        F.flatten(F.collect_list("template")).alias("template"),
    )
    return written(hosts.drop("most").join(references, "host"), "host-wrappers")


def no_text(node: Node) -> bool:
    """Whether an element is marked as something beside the article."""
    if node.hidden or node.tag in NO_TEXT_TAGS:
        return True
    if node.tag == "header":
        return not any(p.tag in ("article", "main") for p in ancestors(node))
    return marked(node)


def marked(node: Node) -> bool:
    """Whether only the words of an element mark it so."""
    return node.tag not in ("html", "body", "main") and bool(node.words & NO_TEXT_WORDS)


def holding_most(page: Page) -> set[Node]:
    """Elements that hold nearly all the running text of a page: whatever their words, they lie around the content."""
    amounts: dict[Node, int] = {}
    total = 0
    for node, text, linked in page.blocks:
        above = [node, *ancestors(node)]
        if (amount := len(text) - linked) > 0 and not any(n.hidden or n.tag in NO_TEXT_TAGS for n in above):
            total += amount
            for owner in above:
                amounts[owner] = amounts.get(owner, 0) + amount
    return {node for node, amount in amounts.items() if amount >= MOST_TEXT * total}


def ancestors(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def content(page: Page, reference: tuple | None, template: set[tuple[int, int]], slot: int | None) -> str:
    """The text of a page's content, blocks joined by an empty line."""
    holds_article = {p for node in page.nodes if node.tag in ("article", "main") for p in ancestors(node)}
    if not holds_article:
        holds_article = {node for node in holding_most(page) if not node.hidden and node.tag not in NO_TEXT_TAGS}
    dropped: set[Node] = set()
    for node in page.nodes:  # parents come first
        if node.parent in dropped or node not in holds_article and no_text(node):
            dropped.add(node)
    kept = [b for b in page.blocks if b[0] not in dropped]
    for node in page.nodes:  # of a header inside the article only its headings
        if node.tag == "header" and node not in dropped:
            kept = [b for b in kept if node not in ancestors(b[0]) and b[0] is not node or b[0].tag in HEADINGS]
    numbers = align(page.skeleton, reference) if reference is not None else {}
    varying = [b for b in kept if (numbers.get(b[0].index), digest(b[1])) not in template]
    kept = varying or kept
    of = lambda tag: [b for b in kept if b[0].tag == tag or any(p.tag == tag for p in ancestors(b[0]))]
    amount = lambda blocks: sum(len(text) for _, text, _ in blocks)
    articles, main = of("article"), of("main")
    if inside := main if amount(articles) < TEASER * amount(main) else articles:
        return "\n\n".join(text for _, text, _ in inside)
    roots = []
    if reference is not None and slot is not None:
        above = parents(reference)[slot]
        roots = [node for node in page.nodes if numbers.get(node.index) == above]
    if not roots or roots[0].tag in ("html", "body"):
        amounts: dict[Node, int] = {}
        for node, text, linked in kept:
            for owner in [node, node.parent] if node.parent is not None else [node]:
                amounts[owner] = amounts.get(owner, 0) + len(text) - 2 * linked
        roots = sorted(amounts, key=amounts.get)[-1:]
    chosen = set(roots)
    inside = [b for b in kept if b[0] in chosen or any(p in chosen for p in ancestors(b[0]))]
    return "\n\n".join(text for _, text, _ in inside)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text) per row of ``pages``, over its whole html."""
    html = F.coalesce(F.col(source), F.lit(""))
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host(F.col(url)).alias("host"), html.alias("html"))
    kind = named.schema["key"].dataType.simpleString()
    wrappers = induce(named.select("host", "html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = []
            for row in batch.select(["html", "reference", "template", "slot"]).to_pylist():
                reference = tree_of(row["reference"]) if row["reference"] is not None else None
                template = {(t["node"], t["hash"]) for t in row["template"] or ()}
                texts.append(content(Page(row["html"]), reference, template, row["slot"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], ["key", "url", "text"])

    met = named.join(wrappers, "host", "left").drop("host")
    return met.mapInArrow(work, f"key {kind}, url string, text string").withColumnsRenamed({"key": key, "url": url})
