"""Test tables projected to catalogue shape; each text is valid in Spark SQL and in DuckDB.

Spark runs it over DataFrames; the same text heads the oracle SQL as a CTE.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "embeddings", "conversations")


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Hand-made names for the rules on Chinese text, dealt over the parts.
NAMES = [
    (0, "[美] 海明威", "美国"), (1, "（英）简·奥斯汀", "英国"), (2, "加西亚·马尔克斯", None), (3, "鲁迅", "中"), (4, "锺书", "中国"), (5, "钟书", "香港"), (6, "Mo Yan", "苏联"), (7, "  ", None),
]
TEXTS = [
    (0, "这是一本网络小说，作者是张三，正在连载。"), (1, "English summary only, no Chinese."), (2, "电视剧由李四执导，主演王五..."), (3, "短"), (4, None), (5, "约12.5万字，页码：321 页"),
    (6, "第 7 集 他们终于见面了"), (7, "内容简介：好书一本。作者简介：某人"), (8, "字数：1,234 first text…"),
]

def six(text: str) -> str:
    """``{{six(x)}}`` of a stand-in: a number with six digits at least."""
    return re.sub(r"{{six\((\w+)\)}}", lambda m: f"CASE WHEN {m[1]} > 999999 THEN cast({m[1]} AS string) ELSE lpad(cast({m[1]} AS string), 6, '0') END", text)


STANDINS = {
    "works": """
      SELECT concat('0101', {{six(o_orderkey)}}) AS id, o_orderkey AS num, 'video' AS module,
        CASE WHEN o_orderkey % 3 = 0 THEN 'movie' WHEN o_orderkey % 3 = 1 THEN 'series' ELSE NULL END AS submodule,
        o_orderpriority AS schema_type, concat('Work ', cast(o_orderkey % 997 AS string)) AS title,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('Original ', cast(o_orderkey % 499 AS string)) END AS title_original,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(year(o_orderdate) AS int) END AS year,
        CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status,
        cast(cast(o_orderdate AS date) AS string) AS updated_at,
        CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE concat('p', cast(o_orderkey AS string), '.jpg') END AS poster,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 90 AS double) / 10 END AS douban,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 80 AS double) / 10 END AS imdb,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderkey % 70 AS double) / 10 END AS tmdb,
        CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE cast(o_orderkey % 101 AS double) END AS rotten_tomatoes
      FROM {orders}""",
    "titles": """
      SELECT concat('0201', {{six(p_partkey)}}) AS id, p_partkey AS num, p_name AS title, p_brand AS studio, lower(p_type) AS genre,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat(p_brand, ' ', p_name) END AS title_original,
        CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE cast(1970 + p_partkey % 51 AS int) END AS year, p_size AS runtime,
        CASE p_partkey % 5 WHEN 0 THEN '美国' WHEN 1 THEN '日本' WHEN 2 THEN '挪威' WHEN 3 THEN '' ELSE NULL END AS country,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_retailprice - 900) / 10 END AS douban,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_retailprice - 890) / 11 END AS goodreads,
        CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat('97', cast(p_partkey % 1500 AS string)) END AS isbn
      FROM {part}""",
    "person": """
      SELECT cast(s_suppkey AS bigint) AS id, concat('Name ', cast(s_suppkey % 83 AS string)) AS name,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name_en,
        CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('p', {{six(s_suppkey)}}) END AS person_id, s_nationkey AS nation
      FROM {supplier}""",
    "work_person": """
      SELECT concat(cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS id, concat('0101', {{six(l_orderkey)}}) AS work_id,
        cast(l_suppkey AS bigint) AS person_id,
        CASE l_returnflag WHEN 'A' THEN 'direction' WHEN 'R' THEN 'writing' ELSE 'cast' END AS department, l_linenumber AS `order`,
        l_linestatus = 'O' AS is_primary, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('c', cast(l_partkey AS string)) END AS character
      FROM {lineitem}""",
    "category": """
      SELECT concat('type:', p_type) AS id, 'type' AS `group`, p_type AS name, 'video' AS module, CAST(NULL AS string) AS submodule, min(p_partkey) AS `order`
      FROM {part} GROUP BY p_type UNION ALL
      SELECT concat('tag:', p_brand), 'tag', p_brand, CAST(NULL AS string), CAST(NULL AS string), min(p_partkey) FROM {part} GROUP BY p_brand""",
    "work_category": """
      SELECT concat('0101', {{six(l_orderkey)}}) AS work_id, concat('type:', p_type) AS category_id, min(l_linenumber) AS `order`
      FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, p_type UNION ALL
      SELECT concat('0101', {{six(l_orderkey)}}), concat('tag:', p_brand), min(l_linenumber)
      FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber > 2 GROUP BY l_orderkey, p_brand""",
    "obs": """
      SELECT l_partkey AS id, concat('s', cast(l_suppkey % 7 AS string)) AS source, cast(min(l_suppkey % 7) AS int) AS `rank`,
        cast(min(CASE WHEN l_partkey % 4 = 1 THEN 2000 + l_suppkey % 3 ELSE 1990 + l_linenumber END) AS int) AS year, cast(max(l_quantity) AS int) AS runtime,
        max(CASE WHEN l_returnflag = 'R' THEN '' ELSE concat(l_returnflag, '-', cast(l_linenumber AS string)) END) AS title,
        max(repeat('x', cast(l_linenumber AS int) * 3)) AS summary, max(CASE WHEN l_linestatus = 'O' THEN NULL ELSE concat('o', cast(l_linenumber AS string)) END) AS title_original
      FROM {lineitem} GROUP BY l_partkey, l_suppkey % 7""",
    "episodes": """
      SELECT concat('v', cast(conv_id AS string)) AS work_id, conv_id AS num, CASE WHEN turn = 6 THEN NULL ELSE cast(turn AS int) + 1 END AS episode,
        CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS group_rank, cast(turn AS int) AS pos,
        CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text, CASE role WHEN 'user' THEN 'plot' ELSE 'page' END AS source
      FROM {conversations}""",
    "episode_counts": """
      SELECT concat('v', cast(conv_id AS string)) AS id, CASE WHEN conv_id % 6 = 0 THEN 0 ELSE cast(2 + conv_id % 4 AS int) END AS episode_count
      FROM {conversations} GROUP BY conv_id""",
    "log": """
      SELECT user_id AS item, event_type AS source, ts,
        CASE WHEN value < 40 THEN 'pending' WHEN value < 70 THEN 'error' WHEN value < 90 THEN 'skipped' ELSE 'done' END AS status FROM {events}""",
    "names": "SELECT p_partkey AS id, cast(p_partkey % 3 AS int) AS pos, v.name, v.country FROM {part} JOIN (VALUES " + values(NAMES) + ") AS v(k, name, country) ON p_partkey % 8 = v.k",
    "texts": "SELECT p_partkey AS id, v.txt FROM {part} JOIN (VALUES " + values(TEXTS) + ") AS v(k, txt) ON p_partkey % 9 = v.k",
    "releases": """
      SELECT l_orderkey AS work_id, l_linenumber AS pos, cast(cast(l_shipdate AS date) AS string) AS date, CASE WHEN l_linestatus = 'O' THEN 'theatrical' ELSE 'other' END AS kind,
        CASE l_suppkey % 5 WHEN 0 THEN '美国' WHEN 1 THEN '戛纳电影节' WHEN 2 THEN '日本' WHEN 3 THEN 'Berlin Festival' ELSE concat('P', cast(l_suppkey AS string)) END AS place
      FROM {lineitem}""",
    "files": """
      SELECT concat('0101', {{six(o_orderkey)}}) AS id, concat('p', cast(o_orderkey AS string), '.jpg') AS poster,
        CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN concat('https://x/', cast(o_custkey AS string)) ELSE concat('s', cast(o_custkey AS string)) END AS still,
        CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('a', cast(o_custkey % 50 AS string)) END AS avatar FROM {orders}""",
    "inventory": """
      SELECT DISTINCT concat('p', cast(o_orderkey AS string), '.jpg') AS path FROM {orders} WHERE o_orderkey % 5 > 0 UNION ALL
      SELECT DISTINCT concat('a', cast(c_custkey % 40 AS string)) FROM {customer} UNION ALL SELECT concat('s', cast(c_custkey AS string)) FROM {customer} WHERE c_custkey % 2 = 0""",
    "candidates": """
      SELECT o.o_orderkey AS query_id, concat('Work ', cast(o.o_orderkey % 40 AS string)) AS query_title, cast(1990 + o.o_orderkey % 12 AS int) AS query_year, l.l_linenumber AS position,
        concat(cast(l.l_partkey AS string), '-', cast(l.l_suppkey AS string)) AS candidate_id, concat('Work ', cast(l.l_partkey % 40 AS string), CASE WHEN l.l_suppkey % 3 = 0 THEN ' II' ELSE '' END) AS title,
        CASE WHEN l.l_suppkey % 4 = 0 THEN NULL ELSE concat('WORK-', cast(l.l_partkey % 40 AS string)) END AS original, CASE WHEN l.l_partkey % 6 = 0 THEN NULL ELSE cast(1990 + l.l_partkey % 12 AS int) END AS year,
        CASE WHEN l.l_returnflag = 'A' THEN 'movie' ELSE 'tv' END AS type, concat('http://h/', CASE WHEN l.l_linestatus = 'O' THEN 'm/' ELSE 'tv/' END, cast(l.l_partkey AS string)) AS url,
        cast(l.l_quantity AS double) AS rating, CASE WHEN l.l_partkey % 4 = 0 THEN '' ELSE concat('Au ', cast(l.l_suppkey % 9 AS string)) END AS author, concat('Au', cast(o.o_custkey % 9 AS string)) AS query_author
      FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
    "payloads": """
      SELECT event_id AS id, event_type AS source, CASE event_id % 6
        WHEN 0 THEN concat('{{"_meta":{{"k":1}},"tags":["a"],"title":"t', cast(event_id % 50 AS string), '","n":', cast(event_id % 9 AS string), '}}')
        WHEN 1 THEN concat('{{"detail":{{"title":"d', cast(event_id % 50 AS string), '"}},"tags":"x"}}') WHEN 2 THEN 'not json' WHEN 3 THEN props
        WHEN 4 THEN concat('{{"_meta":[],"title":" ","extra":"[', chr(92), '"q', chr(92), '"]"}}') ELSE NULL END AS payload FROM {events}""",
    "reviews": """
      SELECT d.doc_id AS id, d.source, d.lang, d.text, CASE d.doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'other' END AS kind FROM {documents} d""",
}

STANDINS = {name: six(text) for name, text in STANDINS.items()}


def ctes() -> str:
    """All stand-ins as the head of an oracle query."""
    names = {b: b for b in BASE}
    parts = [f"{name} AS ({text.format(**names).replace('`', chr(34))})" for name, text in STANDINS.items()]
    return "WITH " + ",\n".join(parts)


class Tables:
    """The driver's tables and the stand-ins by name, each read or projected on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._held = spark, sf_dir, {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            if name in STANDINS:
                used = {b: self.base(b) for b in BASE if "{" + b + "}" in STANDINS[name]}
                self._held[name] = self.spark.sql(STANDINS[name], **used)
            elif name in BASE:
                self._held[name] = self.base(name)
            else:
                raise AttributeError(name)
        return self._held[name]

    @cached_property
    def credits(self) -> DataFrame:
        from lectern.operators.export import credits_join

        return credits_join(self.work_person, self.person)

    @cached_property
    def links(self) -> DataFrame:
        from lectern.operators.export import categories_join

        return categories_join(self.work_category, self.category)
