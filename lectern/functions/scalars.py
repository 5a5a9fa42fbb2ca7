"""Scalar rules as Column expressions: names, titles, numbers, labels, Chinese text.

All are built-in functions, so they stay in generated code; a null input gives
null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"


def nonblank(c: Column) -> Column:
    """Trimmed text, or null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def round1(c: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(c * 10 + 0.5) / 10


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(CJK), F.lit(False))


def is_chinese(c: Column) -> Column:
    """All characters are CJK (at least one)."""
    return F.coalesce(c.rlike(r"^[一-龥]+$"), F.lit(False))


def is_chinese_text(c: Column, least: float = 0.15) -> Column:
    """The CJK share of CJK and Latin letters reaches ``least``."""
    cjk = F.length(F.regexp_replace(c, r"[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.coalesce((cjk > 0) & (cjk / (cjk + latin) >= least), F.lit(False))


def normalize_name_ascii(c: Column) -> Column:
    """Lower case, a-z and digits only (Latin names without accents; see normalize_name for others)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def split_name(c: Column) -> tuple[Column, Column]:
    """(first, last) token in lower case; the last is '' for a single token."""
    parts = F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda x: x != "")
    return F.coalesce(F.get(parts, 0), F.lit("")), F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise("")


def is_reversed_name(a: Column, b: Column) -> Column:
    """First and last token swapped, both names having two tokens or more."""
    (a1, a2), (b1, b2) = split_name(a), split_name(b)
    return (a1 != "") & (a2 != "") & (b1 != "") & (b2 != "") & (a1 == b2) & (a2 == b1)


def normalize_title(c: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\p{Punct}：，。！？·、《》（）【】“”‘’—…]+", "")


def series_key(c: Column) -> Column:
    """Key of a series name: lower case, without spaces, quotes, brackets and separators."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s《》〈〉「」『』\"'()（）:：·・.\-_/]+", ""))


def text_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def split_query(c: Column) -> tuple[Column, Column]:
    """(title, year) of free text; the year is the first 19xx or 20xx."""
    year = F.regexp_extract(c, r"((?:19|20)\d{2})", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\(（]?(?:19|20)\d{2}[\)）]?", " "), r"\s+", " "))
    return title, F.nullif(year, F.lit("")).cast("int")


def parse_int(c: Column) -> Column:
    """First run of digits, commas left out."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def labeled_int(c: Column, *labels: str) -> Column:
    """Number after the first label that has one."""
    found = [F.nullif(F.regexp_replace(F.regexp_extract(c, rf"{label}\s*[：:\s]*([0-9][0-9,]*)", 1), ",", ""), F.lit("")) for label in labels]
    return F.coalesce(*found).try_cast("bigint")


def cjk_number(c: Column) -> Column:
    """Number with an optional multiplier of ten thousand or thousand."""
    n = F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    unit = F.when(c.contains("万"), 10000).when(c.contains("千"), 1000).otherwise(1)
    return F.round(n * unit).cast("bigint")


def year_from_text(c: Column) -> Column:
    """First four digits in a row."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).try_cast("int")


def first_publish_year(*labels: Column) -> Column:
    return F.coalesce(*[year_from_text(c) for c in labels])


def runtime_minutes(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def parse_rating(c: Column) -> Column:
    """struct(value, scale, raw): ``a/b`` to a scale of ten, ``n%`` to its number, else the text alone."""
    top = F.regexp_extract(c, r"([\d.]+)\s*/\s*([\d.]+)", 1).try_cast("double")
    of = F.regexp_extract(c, r"([\d.]+)\s*/\s*([\d.]+)", 2).try_cast("double")
    percent = F.regexp_extract(c, r"([\d.]+)\s*%", 1).try_cast("double")
    value = F.when(top.isNotNull() & (of > 0), top / of * 10).when(percent.isNotNull(), percent)
    scale = F.when(top.isNotNull() & (of > 0), 10).when(percent.isNotNull(), 100)
    return F.struct(value.alias("value"), scale.alias("scale"), c.alias("raw"))


def clean_value(c: Column) -> Column:
    """``N/A`` and blanks to null."""
    return F.nullif(nonblank(c), F.lit("N/A"))


def split_csv(c: Column) -> Column:
    """Comma list to trimmed non-blank items."""
    return F.filter(F.transform(F.split(F.coalesce(clean_value(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_truncation(c: Column) -> Column:
    """Ends with an ellipsis, or has three dots in the last twenty characters."""
    t = F.trim(c)
    return F.coalesce(t.endswith("...") | t.endswith("…") | F.right(t, F.lit(20)).contains("..."), F.lit(False))


def strip_country_prefix(c: Column) -> tuple[Column, Column]:
    """(name, country) of ``[country] name``, with round or square brackets of either width."""
    pattern = r"^\s*[\[【（(〔]\s*([^\]】）)〕]+?)\s*[\]】）)〕]\s*(.+)$"
    hit = c.rlike(pattern)
    return F.when(hit, F.trim(F.regexp_extract(c, pattern, 2))).otherwise(F.trim(c)), F.when(hit, F.regexp_extract(c, pattern, 1))


#: Short and former names of countries to the name that is stored.
COUNTRY_NAMES = {"中": "中国", "中华民国": "中国", "中国大陆": "中国", "台湾": "中国", "香港": "中国", "美": "美国", "英": "英国", "日": "日本", "苏联": "俄罗斯"}


def normalize_country(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COUNTRY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(c)), nonblank(c))


def author_key(c: Column) -> Column:
    """Key under which author names are one: lower case, separators out, variant characters folded."""
    return F.translate(F.lower(c), "锺鐘 ·,-", "钟钟")


#: Headings before and after a shop's summary of a book, in the order in which they are tried.
SUMMARY_STARTS = ["内容简介", "内容介绍", "编辑推荐"]
SUMMARY_STOPS = ["作者简介", "目　　录", "目录", "商品详情", "在线试读", "图书信息"]


def clean_store_summary(*texts: Column) -> Column:
    """The first text that is Chinese once cleaned: what follows the first start mark, in list order, that it has, up to any stop mark not at its beginning, spaces collapsed."""
    return F.coalesce(*map(_store_summary, texts))


def _store_summary(c: Column) -> Column:
    t = F.regexp_replace(c, "\r", "\n")
    t = F.regexp_replace(t, "(?s)^(?:" + "|".join(f".*?{m}" for m in SUMMARY_STARTS) + ")", "")
    for m in SUMMARY_STOPS:
        t = F.regexp_replace(t, f"(?s)^(?!{m})(.+?){m}.*$", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s*重磅推荐\s*", ""), r"\s+", " ")
    t = F.regexp_replace(t, r"^[ 　：:]+|[ 　：:]+$", "")
    return F.when(is_chinese_text(t), t)


def clean_excerpt(c: Column) -> tuple[Column, Column, Column]:
    """(text, note, likes) of a quoted passage: the line noise of users, replies and dates is dropped."""
    likes = F.nullif(F.regexp_extract(c, r"(\d+)\s*(?:赞|有用)", 1), F.lit("")).try_cast("int")
    note = nonblank(F.regexp_extract(c, r"(?:引自|——)\s*([^\n]*)", 1))
    t = F.regexp_replace(c, r"(?:引自|——)[^\n]*", "")
    t = F.regexp_replace(t, r"\d+\s*(?:赞|有用|回应)|\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}(?::\d{2})?)?", "")
    return nonblank(F.regexp_replace(t, r"\s+", " ")), note, likes


def split_person_label(c: Column) -> tuple[Column, Column, Column]:
    """(local name, Latin name, character) of ``local Latin (饰 character)``."""
    character = nonblank(F.regexp_extract(c, r"[\(（]\s*饰\s*([^\)）]+)[\)）]", 1))
    bare = F.trim(F.regexp_replace(c, r"[\(（][^\)）]*[\)）]", ""))
    local = F.regexp_extract(bare, r"^(\S*[一-鿿]\S*)(?:\s+(.*))?$", 1)
    latin = F.when(local != "", nonblank(F.regexp_extract(bare, r"^(\S*[一-鿿]\S*)\s+(.*)$", 2))).otherwise(nonblank(bare))
    return nonblank(local), latin, character


def decode_html_text(c: Column) -> Column:
    """Tags out, common entities decoded, white space collapsed."""
    t = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def episode_number(c: Column) -> Column:
    """Number of ``第 N 集``, or of bare digits."""
    return F.coalesce(
        F.nullif(F.regexp_extract(c, r"第\s*(\d+)\s*[集话話回]", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"^\s*(\d+)\s*$", 1), F.lit(""))
    ).try_cast("int")


def is_placeholder_cover(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"placeholder|default|no[-_]?cover|blank|nopic"), F.lit(False))


def pick_cover_name(url: Column, source: Column, is_main: Column) -> Column:
    """File name of a cover: ``cover.<ext>`` for the main one, ``cover-<source>.<ext>`` for the others."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"(?i)\.(jpe?g|png|webp)(?:\?|$)", 1)), F.lit("")), F.lit("jpg"))
    return F.when(is_main, F.concat(F.lit("cover."), ext)).otherwise(F.concat(F.lit("cover-"), source, F.lit("."), ext))


def split_paragraphs(c: Column, blank_lines: bool = True) -> Column:
    """Trimmed non-blank paragraphs, parted by blank lines or by any line end."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\n\s*\n" if blank_lines else r"\r?\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def content_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def get_path(c: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text; null if any step is missing."""
    return F.get_json_object(c, "$." + path)


def entry_path(module: Column, submodule: Column, id_: Column) -> Column:
    return F.concat(F.lit("/"), F.concat_ws("/", module, nonblank(submodule), id_))


def web_url(c: Column) -> Column:
    """The text if it is an http(s) address."""
    t = nonblank(c)
    return F.when(F.lower(t).rlike(r"^https?://"), t)


def url_part(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


#: Fixed value: what stands in for a missing poster or cover.
PLACEHOLDER = "/assets/poster-placeholder.svg"


def asset_url(file: Column, *place: Column) -> Column:
    """``/assets/{place}/.../{file}``, without the parts of the place that are null; null for a missing file."""
    return F.when(nonblank(file).isNotNull(), F.concat(F.lit("/assets/"), F.concat_ws("/", *place, file)))


def poster_url(file: Column, *place: Column) -> Column:
    return F.coalesce(asset_url(file, *place), F.lit(PLACEHOLDER))


def asset_urls(files: Column, *place: Column) -> Column:
    """URLs of an array of files, in order; an empty array for null."""
    return F.coalesce(F.transform(files, lambda f: asset_url(f, *place)), F.array().cast("array<string>"))


def cover_gallery(covers: Column, id_: Column) -> Column:
    """Array of (source, url) of a book's map of covers by source, in the map's order; empty for null."""
    entries = F.transform(F.map_entries(covers), lambda e: F.struct(e["key"].alias("source"), asset_url(e["value"], F.lit("book"), id_).alias("url")))
    return F.coalesce(entries, F.array().cast("array<struct<source: string, url: string>>"))


def encyclopedia_url(title: Column, id_: Column) -> Column:
    return F.concat(F.lit("https://baike.baidu.com/item/"), url_part(nonblank(title)), F.lit("/"), url_part(nonblank(id_)))


def runtime_label(minutes: Column) -> Column:
    return F.coalesce(F.concat(minutes.cast("string"), F.lit(" 分钟")), F.lit("时长待补充"))


def timecode(minutes: Column) -> Column:
    """h:mm:00"""
    h = F.floor(minutes / 60).cast("string")
    return F.concat(h, F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(":00"))


def platform_rating(value: Column, percent: bool = False) -> Column:
    if percent:
        return F.concat(value.cast("bigint").cast("string"), F.lit("%"))
    return F.when(value.isNotNull(), F.format_string("%.1f", value))
