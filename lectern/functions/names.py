"""Rules on personal names: accent folding as an Arrow-batched pandas UDF, transliteration as joins with a table."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_other = re.compile("[^a-z0-9]")


def _fold(name: str | None) -> str:
    decomposed = unicodedata.normalize("NFKD", (name or "").lower())
    return _other.sub("", "".join(c for c in decomposed if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def normalize_name(name: pd.Series) -> pd.Series:
    """Lower case, accents folded, a-z and digits only; null gives ''."""
    return name.map(_fold, na_action=None).astype(object)


#: A starter table of given names. The full one is a parameter: callers read theirs, of any length, in order.
TRANSLITERATION = {
    "adam": "亚当", "alan": "艾伦", "alex": "亚历克斯", "anna": "安娜", "ben": "本", "bill": "比尔", "bob": "鲍勃", "bruce": "布鲁斯",
    "charles": "查尔斯", "chris": "克里斯", "daniel": "丹尼尔", "david": "大卫",
}


def starter_table(spark: SparkSession) -> DataFrame:
    """The starter table as (place, latin, local)."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(TRANSLITERATION.items())], "place long, latin string, local string")


def transliterate_tokens(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(token, local) of distinct non-empty tokens; ``table``: (place, latin, local), latin in lower case.

    A token takes its own entry; else the first entry, by place, that is its beginning or that begins with its first three
    letters (all of it, if it is shorter); else it stays. Of an entry given twice the place is the first, the text the last.
    The table may have any size: tokens' beginnings are joined with it, and an index has for each beginning of up to three letters the first entry.
    """
    entry = table.groupBy("latin").agg(F.min("place").alias("place"), F.max_by("local", "place").alias("local")).where(F.length("latin") > 0)
    first = F.struct("place", "local")
    lead = entry.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("latin"))), lambda n: F.left(F.col("latin"), n))).alias("lead"), first.alias("e"))
    lead = lead.groupBy("lead").agg(F.min("e").alias("e"))
    word = tokens.select("token").where(F.length("token") > 0).distinct().withColumn("low", F.lower("token"))
    starts = word.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("low")), lambda n: F.struct(F.left(F.col("low"), n).alias("latin"), (n == F.length("low")).alias("whole")))).alias("s"))
    begun = starts.select("token", "s.*").join(entry, "latin").groupBy("token").agg(F.max(F.when(F.col("whole"), F.col("local"))).alias("own"), F.min(first).alias("e"))
    led = word.withColumn("lead", F.left("low", F.lit(3))).join(lead, "lead").select("token", F.col("e").alias("e3"))
    j = word.join(begun, "token", "left").join(led, "token", "left")
    return j.select("token", F.coalesce("own", F.least("e", "e3")["local"], "token").alias("local"))


def transliterate(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, local) of distinct names that are not null: their tokens by the table, joined by '·'."""
    rows = names.select("name").where("name is not null").distinct()
    tokens = rows.select("name", F.posexplode(F.filter(F.split("name", r"\s+"), lambda x: x != "")).alias("pos", "token"))
    found = tokens.join(transliterate_tokens(tokens, table), "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "local"))).alias("x"))
    out = rows.join(found, "name", "left")
    return out.select("name", F.coalesce(F.array_join(F.transform("x", lambda e: e["local"]), "·"), F.lit("")).alias("local"))


def transliteration_match(transliteration: Column, local: Column) -> Column:
    """Equal without separators, or 70 % of the shorter length in common characters when both exceed three."""
    a = F.regexp_replace(F.lower(F.coalesce(local, F.lit(""))), r"[·\s]", "")
    b = F.regexp_replace(F.lower(F.coalesce(transliteration, F.lit(""))), r"[·\s]", "")
    common = F.size(F.filter(F.split(a, ""), lambda x: (x != "") & F.contains(b, x)))
    near = (F.length(a) > 3) & (F.length(b) > 3) & (common >= F.least(F.length(a), F.length(b)) * 0.7)
    return (a != "") & (b != "") & ((a == b) | near)
