"""Web pages as paragraphs, prose blocks, images and documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators.curation import priority_topk, useful_paragraph

BLOCK = r"(?i)<(?:p|div|section|article|main|br|li|h[1-6]|tr|td|blockquote)\b[^>]*>"
#: Character references a page's text is likely to hold; the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_lines(c: str | Column) -> Column:
    """The text lines of a page: no comments, scripts or styles, a line for each block, white space collapsed."""
    x = T.col(c)
    for p, r in ((r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style|noscript)\b.*?</\1>", " "), (BLOCK, "\n"), (r"<[^>]+>", " ")):
        x = F.regexp_replace(x, p, r)
    for e, v in ENTITIES:
        x = F.replace(x, F.lit(e), F.lit(v))
    return T.non_empty(F.transform(F.split(x, r"\n+", -1), lambda s: T.trim(F.regexp_replace(s, rf"{T.WS}+", " "))))


def html_to_paragraphs(pages: DataFrame, lang: str | None = "en", least: int = 90, most: int = 700) -> DataFrame:
    """page_id, idx, text: each distinct line of a page (case aside) that is useful prose; with lang None, every line."""
    rows = pages.select("page_id", F.posexplode(html_lines("html")).alias("idx", "text"))
    if lang:
        rows = rows.filter(useful_paragraph("text", lang, least, most))
    first = rows.groupBy("page_id", F.lower("text").alias("k")).agg(F.min(F.struct("idx", "text")).alias("r"))
    return first.select("page_id", "r.idx", "r.text")


def pages_to_documents(paras: DataFrame, most: int = 4000, least: int = 1200, paragraphs: int = 3) -> DataFrame:
    """page_id, n, text: paragraphs in order up to `most` characters (two for each break), if there are enough of them."""
    run = F.sum(F.char_length("text") + 2).over(Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - 2
    kept = paras.withColumn("upto", run).filter(F.col("upto") <= most)
    joined = kept.groupBy("page_id").agg(F.count("*").alias("n"), F.max("upto").alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    return joined.filter((F.col("n") >= paragraphs) & (F.col("chars") >= least)).select("page_id", "n", "text")


#: Elements that hold prose, and containers whose content is none.
PROSE_TAGS = frozenset(("p", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "figcaption"))
SKIPPED = frozenset(("nav", "header", "footer", "aside", "script", "style", "noscript", "template", "svg", "form", "button", "select", "pre", "code", "head"))


class Blocks(HTMLParser):
    """Leaf prose blocks of one page: (tag, text) in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.open: list[tuple[str, list[str]]] = []
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or self.skip and tag == self.skip[-1]:
            self.skip.append(tag)
        elif not self.skip and tag in PROSE_TAGS:
            if self.open:
                self.open[-1][1].clear()  # a block with a block inside is no leaf
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif self.open and tag == self.open[-1][0]:
            name, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if text:
                self.found.append((name, text))

    def handle_data(self, data):
        if self.open and not self.skip:
            self.open[-1][1].append(data)


def html_prose_blocks(pages: DataFrame, least: int = 20, most: int = 200) -> DataFrame:
    """page_id, idx, tag, text, rank: leaf blocks outside navigation of at least `least` characters; the `most` of a page that matter most (headings and paragraphs first)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                p = Blocks()
                p.feed(html or "")
                rows += [(page, i, tag, text) for i, (tag, text) in enumerate(p.found) if len(text) >= least]
            yield pd.DataFrame(rows, columns=["page_id", "idx", "tag", "text"])

    blocks = pages.select("page_id", "html").mapInPandas(parse, "page_id long, idx long, tag string, text string")
    weight = F.when(F.col("tag").startswith("h"), 3).when(F.col("tag") == "p", 2).otherwise(1)
    return priority_topk(blocks.withColumn("priority", weight), "page_id", "priority", "idx", most).drop("priority")


def page_images(pages: DataFrame, k: int = 8) -> DataFrame:
    """page_id, idx, src, alt, priority, rank: up to k images of a page, those with a description and a size first; icons and data URIs go."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))).alias("idx", "tag"))
    attr = lambda n: F.regexp_extract("tag", rf"(?i)\b{n}\s*=\s*[\"']([^\"']*)[\"']", 1)
    largest = F.regexp_extract(attr("srcset"), r"([^\s,]+)(?:\s+[\d.]+[wx])?\s*$", 1)
    src = F.when(largest != "", largest).otherwise(attr("src"))
    x = rows.select("page_id", "idx", src.alias("src"), attr("alt").alias("alt"), F.expr("try_cast(regexp_extract(tag, '(?i)\\\\bwidth\\\\s*=\\\\s*[\"\\']?(\\\\d+)', 1) as int)").alias("width"))
    x = x.filter((F.col("src") != "") & ~F.lower("src").rlike(r"^data:|sprite|icon|logo|\.svg"))
    score = F.when(F.char_length("alt") >= 10, 2).when(F.col("alt") != "", 1).otherwise(0) + F.when(F.coalesce("width", F.lit(0)) >= 300, 2).otherwise(0)
    return priority_topk(x.withColumn("priority", score), "page_id", "priority", "idx", k).select("page_id", "idx", "src", "alt", "priority", "rank")


__all__ = ["html_lines", "html_prose_blocks", "html_to_paragraphs", "page_images", "pages_to_documents"]
