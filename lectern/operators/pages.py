"""Extraction from stored web pages: one pass over (page_id, url, html), no shuffle.

Patterns that a regular expression can hold are built-in functions; nested
markup goes through one html.parser helper in Arrow batches.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import decode_html_text, nonblank

#: Marks of verification and shell pages.
BLOCKED_MARKS = ["百度安全验证", "wappass.baidu.com", "验证码", "Access Denied", "Just a moment"]


def page_validity(pages: DataFrame, marks: list[str] = BLOCKED_MARKS, least: int = 64) -> DataFrame:
    """(page_id, valid): the page is long enough and has none of the marks; a null page is not valid."""
    bad = F.length("html") < least
    for m in marks:
        bad = bad | F.col("html").contains(m)
    return pages.select("page_id", F.coalesce(~bad, F.lit(False)).alias("valid"))


def page_heading(pages: DataFrame) -> DataFrame:
    """(page_id, heading): text of the first h1, else the title without its site suffix."""
    h1 = nonblank(decode_html_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    title = decode_html_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", F.coalesce(h1, nonblank(F.regexp_replace(title, r"\s*[|_-][^|_-]*$", ""))).alias("heading"))


def page_embedded_json(pages: DataFrame, name: str) -> DataFrame:
    """(page_id, payload): the JSON object assigned to a script variable, or of a JSON-LD block of type ``name``."""
    var = F.regexp_extract("html", rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    ld = F.regexp_extract("html", rf'(?s)<script[^>]*application/ld\+json[^>]*>\s*(\{{[^<]*"@type"\s*:\s*"{name}"[^<]*\}})\s*</script>', 1)
    found = F.coalesce(F.nullif(var, F.lit("")), F.nullif(ld, F.lit("")))
    return pages.select("page_id", F.when(F.try_parse_json(found).isNotNull(), found).alias("payload"))


def page_label_values(pages: DataFrame, labels: list[str]) -> DataFrame:
    """(page_id, label, value) of ``label:</span> value`` facts."""
    facts = F.array(*[F.struct(F.lit(x).alias("label"), nonblank(decode_html_text(F.regexp_extract("html", rf"(?s){x}\s*[:：]?\s*</span>\s*[:：]?(.*?)(?:<br|</p>|</li>|</div>)", 1))).alias("value")) for x in labels])
    return pages.select("page_id", F.explode(facts).alias("f")).select("page_id", "f.*").where("value is not null")


def page_ranked_list(pages: DataFrame) -> DataFrame:
    """(page_id, rank, title): list items in order, tags out, blanks dropped."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)
    rows = pages.select("page_id", F.posexplode(items).alias("pos", "raw"))
    return rows.select("page_id", (F.col("pos") + 1).alias("rank"), nonblank(decode_html_text(F.col("raw"))).alias("title")).where("title is not null")


def non_book_entry(text: Column, against: list[str], for_: list[str]) -> Column:
    """Has a mark of a screen work and none of a book."""
    any_ = lambda marks: F.coalesce(text.rlike("|".join(marks)), F.lit(False))
    return any_(against) & ~any_(for_)


class _Reader(HTMLParser):
    """Collects headings with their text, definition pairs, list items, table rows, quotes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.buf, self.label = [], [], ""
        self.heading = ""
        self.pairs, self.sections, self.lists, self.rows, self.row = [], {}, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "dt", "dd", "li", "p", "td", "th", "blockquote"):
            self.stack.append(tag)
            self.buf = []
        elif tag == "tr":
            self.row = []

    def handle_data(self, data):
        if self.stack:
            self.buf.append(data)

    def handle_endtag(self, tag):
        if tag == "tr" and self.row:
            self.rows.append((self.heading, self.row))
            self.row = []
        if not self.stack or tag != self.stack[-1]:
            return
        self.stack.pop()
        text = " ".join("".join(self.buf).split())
        self.buf = []
        if tag in ("h1", "h2", "h3"):
            self.heading = text
        elif tag == "dt":
            self.label = text.strip(":： ")
        elif tag == "dd" and self.label and len(self.label) <= 20:
            self.pairs.append((self.label, text))
        elif tag in ("td", "th"):
            self.row.append(text)
        elif tag in ("li", "blockquote"):
            self.lists.append((self.heading, text))
        if tag in ("p", "li", "dd") and len(text) >= 8:
            self.sections.setdefault(self.heading, []).append(text)


PARSED = "page_id long, infobox map<string,string>, sections map<string,string>, lists array<struct<heading:string,item:string>>, table_rows array<struct<heading:string,cells:array<string>>>"


def _parse(batches):
    kinds = [
        pa.int64(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()),
        pa.list_(pa.struct([("heading", pa.string()), ("item", pa.string())])),
        pa.list_(pa.struct([("heading", pa.string()), ("cells", pa.list_(pa.string()))])),
    ]
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for html in b.column("html").to_pylist():
            r = _Reader()
            r.feed(html or "")
            r.close()
            info: dict[str, str] = {}
            for k, v in r.pairs:
                info.setdefault(k, v)
            cols[0].append(list(info.items()))
            cols[1].append([(k, "\n".join(dict.fromkeys(v))) for k, v in r.sections.items()])
            cols[2].append([{"heading": h, "item": i} for h, i in dict.fromkeys(r.lists)])
            cols[3].append([{"heading": h, "cells": c} for h, c in r.rows])
        yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names=["page_id", "infobox", "sections", "lists", "table_rows"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """One struct row per page: infobox (first label wins, labels up to 20 characters), section texts, list items, table rows."""
    return pages.select("page_id", "html").mapInArrow(_parse, PARSED)


def page_infobox(parsed: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(page_id, field, value): infobox labels named by the alias map."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    rows = parsed.select("page_id", F.explode("infobox").alias("label", "value"))
    return rows.select("page_id", F.try_element_at(table, F.col("label")).alias("field"), "value").where("field is not null")


def page_section(parsed: DataFrame, heading_pattern: str) -> DataFrame:
    """(page_id, heading, text) of the sections whose heading matches."""
    return parsed.select("page_id", F.explode("sections").alias("heading", "text")).where(F.col("heading").rlike(heading_pattern))


def page_lists(parsed: DataFrame, heading_pattern: str = "") -> DataFrame:
    """(page_id, heading, item): distinct list items after a heading, footnote marks removed."""
    rows = parsed.select("page_id", F.explode("lists").alias("x")).select("page_id", "x.heading", F.trim(F.regexp_replace("x.item", r"\[\d+\]", "")).alias("item"))
    return rows.where(F.col("heading").rlike(heading_pattern) & (F.col("item") != "")).distinct()


def page_episodes(pages: DataFrame) -> DataFrame:
    """(page_id, episode, text) of ``第 N 集`` blocks in the page text."""
    text = decode_html_text(F.col("html"))
    blocks = F.regexp_extract_all(text, F.lit(r"(第\s*\d+\s*[集话回][^第]*)"), 1)
    rows = pages.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    return rows.select(
        "page_id", F.regexp_extract("block", r"第\s*(\d+)", 1).try_cast("int").alias("episode"), nonblank(F.regexp_replace("block", r"^第\s*\d+\s*[集话回]\s*", "")).alias("text")
    ).where("text is not null")


def page_characters(parsed: DataFrame) -> DataFrame:
    """(page_id, character, actor): list items of the form ``character 演员 actor`` or ``actor 饰 character``, distinct."""
    rows = parsed.select("page_id", F.explode("lists").alias("x")).select("page_id", F.col("x.item").alias("item"))
    a, b = r"^(.+?)\s*演员\s*[:：]?\s*(.+)$", r"^(.+?)\s*饰\s*[:：]?\s*(.+)$"
    character = F.when(F.col("item").rlike(a), F.regexp_extract("item", a, 1)).when(F.col("item").rlike(b), F.regexp_extract("item", b, 2))
    actor = F.when(F.col("item").rlike(a), F.regexp_extract("item", a, 2)).when(F.col("item").rlike(b), F.regexp_extract("item", b, 1))
    return rows.select("page_id", character.alias("character"), actor.alias("actor")).where("character is not null").distinct()
