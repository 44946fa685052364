"""Views over the driver's tables that play the part of readings; the SQL text runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "survey_cells": """
SELECT e.row_no, f.ord, f.field, f.l, e.t, f.r, e.b FROM (VALUES (1,'bug_name',0.0704e0,0.2424e0),(2,'symbol',0.2424e0,0.2766e0),(3,'where',0.2766e0,0.4138e0),(4,'what_doing',0.4138e0,0.5195e0),(5,'found_month',0.5248e0,0.5634e0),(6,'found_day',0.5634e0,0.6027e0),(7,'location_town',0.6027e0,0.6847e0),(8,'location_chome',0.6847e0,0.7263e0),(9,'location_name',0.7263e0,0.8355e0),(10,'map_symbol',0.8355e0,0.8804e0),(11,'notice',0.8804e0,0.9968e0)) AS f(ord, field, l, r) CROSS JOIN (VALUES (1,0.0364e0,0.1526e0),(2,0.1526e0,0.2712e0),(3,0.2712e0,0.3877e0),(4,0.3877e0,0.5055e0),(5,0.5055e0,0.6227e0),(6,0.6227e0,0.7406e0),(7,0.7406e0,0.8582e0),(8,0.8582e0,0.9764e0)) AS e(row_no, t, b)
""",
    "survey_entries": """
SELECT l_orderkey AS page_id,
 ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS position,
 CASE WHEN l_partkey % 97 = 0 THEN 'no.' || CAST(l_linenumber AS STRING)
      WHEN l_partkey % 89 = 0 THEN '9' WHEN l_partkey % 83 = 0 THEN 'inf'
      WHEN l_partkey % 5 = 0 THEN CAST(l_linenumber AS STRING) || '.0' ELSE CAST(l_linenumber AS STRING) END AS no_raw,
 CASE WHEN l_partkey % 41 = 0 THEN '〃' WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'ストロ윤인'
      ELSE split_part('シオカラトンボ|しおからとんぼ|シオカラトンホ|カマキリ|キアゲハの幼虫|㋐ゲハ|カナブン|たぶんギンヤンマ', '|', CAST(1 + l_partkey % 8 AS INT)) END AS bug_name,
 substr('あいうえおかきくけん', CAST(1 + l_suppkey % 10 AS INT), 1) AS symbol,
 split_part('道の上|家の前|高い木|葉っぱ|花だん|しめった地面|池のそば||みなと図書室|駐車場', '|', CAST(1 + (l_suppkey + l_linenumber) % 10 AS INT)) AS where_,
 split_part('①|②|③|④|⑤|⑥|⑦|⑧|⑨|⑩|⑪|4||11|❹', '|', CAST(1 + CAST(l_quantity AS BIGINT) % 15 AS INT)) AS what_doing,
 CASE WHEN l_linenumber = 3 AND l_suppkey % 5 = 0 THEN '④'
      WHEN month(l_shipdate) < 10 AND l_suppkey % 2 = 0 THEN substr('０１２３４５６７８９', CAST(1 + month(l_shipdate) AS INT), 1)
      ELSE CAST(month(l_shipdate) AS STRING) END AS found_month,
 CASE WHEN l_partkey % 31 = 0 THEN '/' ELSE '' END || CAST(day(l_shipdate) AS STRING) AS found_day,
 split_part('芝公園|白金台|こもろ|家の前||코모로|六本木', '|', CAST(1 + l_orderkey % 7 AS INT)) AS location_town,
 CASE WHEN l_suppkey % 11 = 0 THEN '山' WHEN l_suppkey % 7 = 0 THEN '' ELSE CAST(1 + l_partkey % 5 AS STRING) END AS location_chome,
 split_part('芝公園|みなと図書室|バングエド(フィリピン)|バングエド||麻布小学校|新橋駅', '|', CAST(1 + (l_orderkey + l_linenumber) % 7 AS INT)) AS location_name,
 split_part('G|Ⓖ|ⓖ|b|Z|Ｈ||더|K|ℊ', '|', CAST(1 + l_partkey % 10 AS INT)) AS map_symbol,
 CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_suppkey % 8 = 0 THEN 'いけの上に' || chr(10) || 'とまった' ELSE '　㊂びきいた ' END AS notice
FROM lineitem
""",
    "survey_long": """
SELECT s.page_id, s.position, s.no_raw, f.ord, f.field,
 CASE f.ord WHEN 1 THEN s.bug_name WHEN 2 THEN s.symbol WHEN 3 THEN s.where_ WHEN 4 THEN s.what_doing WHEN 5 THEN s.found_month WHEN 6 THEN s.found_day
  WHEN 7 THEN s.location_town WHEN 8 THEN s.location_chome WHEN 9 THEN s.location_name WHEN 10 THEN s.map_symbol ELSE s.notice END AS raw
FROM survey_entries s CROSS JOIN (VALUES (1,'bug_name',0.0704e0,0.2424e0),(2,'symbol',0.2424e0,0.2766e0),(3,'where',0.2766e0,0.4138e0),(4,'what_doing',0.4138e0,0.5195e0),(5,'found_month',0.5248e0,0.5634e0),(6,'found_day',0.5634e0,0.6027e0),(7,'location_town',0.6027e0,0.6847e0),(8,'location_chome',0.6847e0,0.7263e0),(9,'location_name',0.7263e0,0.8355e0),(10,'map_symbol',0.8355e0,0.8804e0),(11,'notice',0.8804e0,0.9968e0)) AS f(ord, field, l, r)
""",
    "survey_boxes": """
SELECT x.page_id, x.position * 100 + x.ord * 2 + p.part AS seq,
 CASE WHEN p.part = 0 THEN substr(x.raw, 1, x.h) ELSE substr(x.raw, x.h + 1) END AS text,
 CASE WHEN x.page_id % 29 = 0 AND x.ord = 1 THEN 0.045e0 WHEN x.page_id % 31 = 0 AND x.ord = 4 THEN 0.5200e0 ELSE x.l + (x.r - x.l) * 0.5e0 * p.part END AS l,
 x.t AS t,
 CASE WHEN x.page_id % 29 = 0 AND x.ord = 1 THEN 0.065e0 WHEN x.page_id % 31 = 0 AND x.ord = 4 THEN 0.5240e0 ELSE x.l + (x.r - x.l) * 0.5e0 * (p.part + 1) END AS r,
 x.b AS b, (x.page_id + x.ord + x.position) % 9 = 0 AS unsure
FROM (SELECT g.page_id, g.position, g.ord, g.raw, CAST(floor((length(g.raw) + 1) / 2e0) AS INT) AS h, c.l, c.t, c.r, c.b
      FROM survey_long g JOIN survey_cells c ON c.ord = g.ord AND CAST(c.row_no AS STRING) = replace(g.no_raw, '.0', '')
      WHERE g.raw <> '') x
 CROSS JOIN (VALUES (0),(1)) AS p(part)
WHERE p.part = 0 OR length(x.raw) > x.h
""",
    "survey_header": """
SELECT o_orderkey AS page_id, split_part('芝|白金||고|御成門', '|', CAST(1 + o_custkey % 5 AS INT)) AS school,
 split_part('4|④|４|x||年|5', '|', CAST(1 + o_orderkey % 7 AS INT)) AS grade, split_part('2| 1 |ー|⓪|', '|', CAST(1 + o_custkey % 4 AS INT)) AS school_class FROM orders
""",
    "survey_unsure": """
SELECT *, CASE (page_id + position) % 6 WHEN 0 THEN '["notice"]' WHEN 1 THEN '["symbol","colour"]' WHEN 2 THEN '[]' WHEN 3 THEN '["where","where",null]' WHEN 4 THEN '"notice"' END AS unsure FROM survey_entries
""",
    "survey_oddities": """
SELECT l_orderkey AS page_id, count(*) + 1 AS position, '"oops"' AS odd FROM lineitem WHERE l_orderkey % 51 = 12 GROUP BY l_orderkey
""",
    "survey_marks": """
SELECT page_id, position, no_raw, k.kind, CASE k.kind WHEN 'outside_minato' THEN split_part('◎|○|△|〇|| ◎ ', '|', CAST(1 + (page_id + position) % 6 AS INT)) ELSE split_part('◎|○|△||', '|', CAST(1 + (page_id + position * 2) % 5 AS INT)) END AS mark
FROM survey_entries CROSS JOIN (VALUES ('outside_minato'),('target_species')) AS k(kind) WHERE (page_id + position) % 4 <> 3
""",
    "attempt_log": """
SELECT user_id AS page_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, ts AS started_at,
 value AS seconds, event_type = 'purchase' AS ok, CASE WHEN event_id % 3 = 0 THEN 'alpha' WHEN event_id % 3 = 1 THEN 'beta' ELSE 'gamma' END AS model,
 3000 + event_id % 500 AS prompt_tokens, 400 + event_id % 900 AS answer_tokens, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 300 END AS thought_tokens
FROM events
""",
}
BASE = {"survey_cells": [], "survey_entries": ["lineitem"], "survey_long": ["survey_entries"], "survey_boxes": ["survey_long", "survey_cells"], "survey_header": ["orders"], "survey_unsure": ["survey_entries"], "survey_oddities": ["lineitem"], "survey_marks": ["survey_entries"], "attempt_log": ["events"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key by which a view's own window goes: its table is brought together by that, so that only the columns that are read move, not the texts made of them.
KEYS = {"lineitem": "l_orderkey", "events": "user_id"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, without registering names in the session.

    Entries, what is made of them and the log come partitioned by page_id: Spark follows the table's key through its new name, so work by page needs no other shuffle.
    """
    text, used = VIEWS[name], {}
    for base in BASE[name]:
        if base in VIEWS:
            used[base] = view(spark, sf_dir, base)
        else:
            read = table(spark, sf_dir, base)
            used[base] = read.repartition(KEYS[base]) if base in KEYS and "OVER" in text else read
        text = text.replace(f"FROM {base}", f"FROM {{{base}}}").replace(f"JOIN {base}", f"JOIN {{{base}}}")
    return spark.sql(text, **used)


def prelude() -> list[str]:
    """The views as common table expressions."""
    return [f"{name} AS ({text.strip()})" for name, text in VIEWS.items()]
