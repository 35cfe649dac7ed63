"""Blocks of HTML pages: headings, paragraphs, tables, definitions, lists and captions, in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of one page that a policy may ask for: blocks, table cells, characters of a block.  None are set by default.
POLICY_LIMITS = (10_000, 50_000, 100_000)
NO_LIMITS = (None, None, None)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_BLOCKS = {
    **{f"h{k}": "heading" for k in range(1, 7)},
    "p": "paragraph",
    "table": "table",
    "dl": "definition",
    "ul": "list",
    "ol": "list",
    "figcaption": "figure_caption",
    "caption": "table_caption",
    "note": "note",
    "li": "list_item",
}
#: A start tag that ends an open paragraph, item, term, row or cell without an end tag.
_ENDS = {
    "p": {"p"},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
}
_BREAKS_P = frozenset("div ul ol dl table h1 h2 h3 h4 h5 h6 section article nav header footer form pre".split())
SCHEMA = (
    "page_id long, seq int, kind string, text string, section string, level int, "
    "rows array<struct<label:string,value:string,row:int>>, n_cells int, truncated boolean"
)


class _Reader(HTMLParser):
    """Gathers the text of open block elements; a block inside another block belongs to the outer one."""

    def __init__(self, limits: tuple[int | None, int | None, int | None] = NO_LIMITS):
        super().__init__(convert_charrefs=True)
        self.most_blocks, self.most_cells, self.most_chars = (float("inf") if x is None else x for x in limits)
        self.blocks: list[dict] = []
        self.open: list[str] = []
        self.current: dict | None = None
        self.depth = 0
        self.section: str | None = None
        self.cells = 0
        self.full = False

    def _start_block(self, tag: str) -> None:
        self.current = {"tag": tag, "text": [], "rows": [], "row": None, "cell": None, "pairs": [], "term": None, "items": []}
        self.depth = len(self.open)

    def handle_starttag(self, tag: str, attrs) -> None:
        while self.open and (self.open[-1] in _ENDS.get(tag, ()) or (self.open[-1] == "p" and tag in _BREAKS_P)):
            self._close(self.open[-1])
        if tag in _VOID:
            self.handle_data(" ")
            return
        if self.current is None and tag in _BLOCKS:
            self._start_block(tag)
        self.open.append(tag)
        c = self.current
        if c is None:
            return
        if c["tag"] == "table":
            if tag == "tr":
                c["row"] = []
            elif tag in ("td", "th") and c["row"] is not None:
                c["cell"] = []
        elif c["tag"] == "dl" and tag in ("dt", "dd") or c["tag"] in ("ul", "ol") and tag == "li":
            c["cell"] = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open[-1] != tag:
                self._close(self.open[-1])
            self._close(tag)

    def _close(self, tag: str) -> None:
        self.open.pop()
        c = self.current
        if c is None:
            return
        inner = _clean(c["cell"])
        if tag in ("td", "th") and c["row"] is not None and c["cell"] is not None:
            c["row"].append(inner)
            c["cell"] = None
        elif tag == "tr" and c["row"] is not None:
            if any(c["row"]):
                c["rows"].append(c["row"])
            c["row"] = None
        elif tag == "dt" and c["cell"] is not None:
            c["term"], c["cell"] = inner, None
        elif tag == "dd" and c["cell"] is not None:
            if c["term"] and inner:
                c["pairs"].append((c["term"], inner))
            c["term"] = c["cell"] = None
        elif tag == "li" and c["cell"] is not None and c["tag"] in ("ul", "ol"):
            if inner:
                c["items"].append(inner)
            c["cell"] = None
        if len(self.open) <= self.depth:
            self._finish()

    def handle_data(self, data: str) -> None:
        if self.current is not None and not _HIDDEN.intersection(self.open):
            self.current["text"].append(data)
            if self.current["cell"] is not None:
                self.current["cell"].append(data)

    def _finish(self) -> None:
        c, self.current = self.current, None
        tag, rows = c["tag"], []
        text = _clean(c["text"])
        if tag == "dl":
            rows = [(a, b, 0) for a, b in c["pairs"]]
            text = " ".join(f"{a}: {b}" for a, b in c["pairs"])
        elif tag in ("ul", "ol"):
            text = " ".join(c["items"])
        elif tag == "table":
            rows = [(r[0], " ".join(r[1:]) if len(r) > 1 else r[0], k + 1) for k, r in enumerate(c["rows"])]
        if not text:
            return
        counts = [sum(map(bool, r)) for r in c["rows"]]
        cells = sum(counts)
        if len(self.blocks) >= self.most_blocks:
            self.full = True
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.section = text
        kept = 0
        for k, n in enumerate(counts):
            # whole rows, as far as the limit goes
            if self.cells + kept + n > self.most_cells:
                rows = rows[:k]
                break
            kept += n
        self.cells += kept
        short = len(text) > self.most_chars
        self.blocks.append(
            {
                "kind": _BLOCKS[tag],
                "text": text[: self.most_chars] if short else text,
                "section": self.section,
                "level": int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None,
                "rows": [{"label": a, "value": b, "row": k} for a, b, k in rows],
                "n_cells": kept,
                "truncated": short or kept < cells,
            }
        )


def _clean(parts: list[str] | None) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip() if parts else ""


def blocks_of(html: str, limits: tuple[int | None, int | None, int | None] = NO_LIMITS) -> list[dict]:
    """The blocks of one page, in order; headings set the section of what follows.  With limits (blocks, table cells,
    characters of a block) a block that was shortened, or after which blocks are missing, is marked ``truncated``."""
    reader = _Reader(limits)
    reader.feed(html)
    while reader.open:
        reader._close(reader.open[-1])
    if reader.full and reader.blocks:
        reader.blocks[-1]["truncated"] = True
    return reader.blocks


def html_blocks(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limits: tuple[int | None, int | None, int | None] = NO_LIMITS
) -> DataFrame:
    """One row per block of every page, whole unless ``limits`` are given.  A page without blocks, empty or null, has no
    row."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                found = [
                    {"page_id": page, "seq": seq, **block}
                    for page, html in zip(part["page_id"], part["html"], strict=True)
                    for seq, block in enumerate(blocks_of(html or "", limits))
                ]
                columns = [c.strip().split()[0] for c in re.sub("<.*?>>", "", SCHEMA).split(",")]
                yield pd.DataFrame(found, columns=columns).astype({"level": "Int32"})

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return slim.mapInPandas(extract, SCHEMA)


_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of a start tag, quoted or not; empty where it is missing."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def scripts(html: Column) -> Column:
    """The script elements of a page outside comments, in order: an array of ``id, media_type, text``."""
    page = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(page, F.lit(_SCRIPT), F.lit(0))
    start = lambda x: F.regexp_extract(x, _SCRIPT, 1)
    return F.transform(
        found,
        lambda x: F.struct(
            _attribute(start(x), "id").alias("id"),
            F.lower(F.trim(F.substring_index(_attribute(start(x), "type"), ";", 1))).alias("media_type"),
            F.regexp_extract(x, _SCRIPT, 2).alias("text"),
        ),
    )


def embedded_json(pages: DataFrame, script_id: str, media_type: str = "application/json", html_col: str = "html") -> DataFrame:
    """``pages`` with ``json`` and ``json_status``: the text of the one script element with that id and media type.

    Several such scripts are ambiguous, never the first; ``not_found``, ``invalid`` (no JSON) and ``missing_text`` (null page) are
    told apart, and only ``found`` has a value.  Built-in functions only.
    """
    hits = F.filter(scripts(F.col(html_col)), lambda s: (s["id"] == script_id) & (s["media_type"] == media_type))
    out = pages.withColumn("_hits", hits)
    text = F.get("_hits", F.lit(0))["text"]
    sound = F.try_parse_json(text).isNotNull()
    status = (
        F.when(F.col(html_col).isNull(), F.lit("missing_text"))
        .when(F.size("_hits") > 1, F.lit("ambiguous"))
        .when(F.size("_hits") == 0, F.lit("not_found"))
        .when(sound, F.lit("found"))
        .otherwise(F.lit("invalid"))
    )
    return out.withColumn("json_status", status).withColumn("json", F.when(F.col("json_status") == "found", text)).drop("_hits")


def linked_data(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, ordinal, json`` of every JSON-LD script of the pages that is JSON, in order from 1."""
    found = pages.select(id_col, F.posexplode(F.filter(scripts(F.col(html_col)), lambda s: s["media_type"] == "application/ld+json")).alias("k", "s"))
    return found.where(F.try_parse_json("s.text").isNotNull()).select(id_col, (F.col("k") + 1).alias("ordinal"), F.col("s.text").alias("json"))
