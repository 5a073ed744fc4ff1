"""Topic tags of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.topics import STOP, Topic, Unit, tagged
from ..sources.tables import load
from .registry import query

VERSION = "plan-3"
PLAN = (
    Topic("T1", ("ther", "onon thha"), (Unit("T1-001", ("erth thre", "St erth ther"), cluster="c1", tier="A"), Unit("T1-002", ("ouou ed eren",), cluster="c2", tier="B"), Unit("T1-R01", ("~enen",), "relation")), ("ther thre", "of anre ther")),
    Topic("T2", ("der die", "sich"), (Unit("T2-001", ("und the ung", "~die lich"), cluster="c1", tier="A"), Unit("T2-002", ("ver ein sich",), cluster="c3")), ("sich ung",)),
    Topic("T3", ("les", "dés que"), (Unit("T3-001", ("le les sur",)), Unit("T3-002", ("qui que",), tier="C"))),
)
#: The same plan for the other engine: (topic, unit's number, place, term, its stems), with the shorter form of a term where it has one.
_TERMS = (
    ("T1", 0, 0, "ther", ("ther",)), ("T1", 0, 1, "onon thha", ("onon", "thha")), ("T1", 1, 0, "erth thre", ("erth", "thre")), ("T1", 1, 1, "St erth ther", ("st", "erth", "ther")), ("T1", 1, 1, "St erth ther", ("st", "erth")),
    ("T1", 2, 0, "ouou ed eren", ("ouou", "ed", "eren")), ("T1", 3, 0, "~enen", ("enen",)),
    ("T2", 0, 0, "der die", ("der", "die")), ("T2", 0, 1, "sich", ("sich",)), ("T2", 1, 0, "und the ung", ("und", "ung")), ("T2", 1, 1, "~die lich", ("die", "lich")), ("T2", 2, 0, "ver ein sich", ("ver", "ein", "sich")), ("T2", 2, 0, "ver ein sich", ("ver", "ein")),
    ("T3", 0, 0, "les", ("les",)), ("T3", 0, 1, "dés que", ("des", "que")), ("T3", 1, 0, "le les sur", ("le", "les", "sur")), ("T3", 1, 0, "le les sur", ("le", "sur")), ("T3", 2, 0, "qui que", ("qui", "que")),
)
_PHRASES = (("T1", ("ther", "thre")), ("T1", ("anre", "ther")), ("T2", ("sich", "ung")))
_UNITS = (
    ("T1", 0, "T1-?", "unassigned", None, None), ("T1", 1, "T1-001", "subtopic", "c1", "A"), ("T1", 2, "T1-002", "subtopic", "c2", "B"), ("T1", 3, "T1-R01", "relation", None, None),
    ("T2", 0, "T2-?", "unassigned", None, None), ("T2", 1, "T2-001", "subtopic", "c1", "A"), ("T2", 2, "T2-002", "subtopic", "c3", None),
    ("T3", 0, "T3-?", "unassigned", None, None), ("T3", 1, "T3-001", "subtopic", None, None), ("T3", 2, "T3-002", "subtopic", None, "C"),
)


def _value(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "[" + ", ".join(map(_value, x)) + "]" if isinstance(x, tuple) else f"'{x}'"


def _values(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + ")"


_CUT = "CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 5 AND x LIKE '%ing' THEN left(x, length(x) - 3) WHEN length(x) > 4 AND x LIKE '%ed' THEN left(x, length(x) - 2) WHEN length(x) > 4 AND regexp_matches(x, '(ss|sh|ch|x|z)es$') THEN left(x, length(x) - 2) WHEN length(x) > 3 AND regexp_matches(x, '[^sui]s$') THEN left(x, length(x) - 1) ELSE x END"
_TAGS = f"""docs AS (SELECT doc_id, split_part(text, '.', 1) AS title, substr(text, length(split_part(text, '.', 1)) + 2) AS rest, text FROM documents),
raw AS (SELECT doc_id, CASE WHEN trim(rest) <> '' AND trim(rest) <> trim(title) THEN 'title_abstract' ELSE 'title' END AS matched_on, list_filter(regexp_split_to_array(regexp_replace(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[''’]s\\b', '', 'g'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {STOP}) AS w FROM docs),
cut AS (SELECT doc_id, matched_on, list_transform(w, lambda x: {_CUT}) AS w FROM raw),
stems AS (SELECT doc_id, matched_on, list_transform(w, lambda x: CASE WHEN length(x) > 3 AND right(x, 1) = substr(x, length(x) - 1, 1) AND contains('bcdghjkmnpqrtvwxy', right(x, 1)) THEN left(x, length(x) - 1) ELSE x END) AS w FROM cut),
phrases AS (SELECT col0 AS topic, col1 AS p FROM {_values(_PHRASES)}),
topics AS (SELECT DISTINCT col0 AS topic FROM {_values(_UNITS)}),
taken AS (SELECT doc_id, topic, list_distinct(flatten(list(list_transform(range(1, len(p) + 1), lambda j: i + j - 1)))) AS cov FROM (SELECT doc_id, topic, p, w, unnest(range(1, len(w) - len(p) + 2)) AS i FROM stems, phrases) WHERE w[i:i + len(p) - 1] = p GROUP BY doc_id, topic),
masked AS (SELECT doc_id, matched_on, topic, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(coalesce(cov, []), i) THEN '' ELSE w[i] END) AS w FROM stems CROSS JOIN topics LEFT JOIN taken USING (doc_id, topic)),
terms AS (SELECT col0 AS topic, col1 AS owner, col2 AS place, col3 AS raw, col4 AS s FROM {_values(_TERMS)}),
lists AS (SELECT doc_id, matched_on, topic, owner, place, raw, len(s) AS n, list_transform(s, lambda x: list_filter(range(1, len(w) + 1), lambda i: w[i] = x)) AS p FROM masked JOIN terms USING (topic) WHERE list_has_all(w, s)),
nearest AS (SELECT * EXCLUDE (p), list_transform(p[1], lambda a: list_transform(p, lambda l: list_sort(list_transform(l, lambda b: [abs(b - a), b - a]))[1])) AS near FROM lists),
hits AS (SELECT DISTINCT doc_id, matched_on, topic, owner, place, raw FROM nearest WHERE n = 1 OR len(list_filter(near, lambda x: list_max(list_transform(x, lambda y: y[1])) < n + 2 AND list_max(list_transform(x, lambda y: y[2])) - list_min(list_transform(x, lambda y: y[2])) < n + 2)) > 0),
anchors AS (SELECT doc_id, matched_on, topic, list(raw ORDER BY place) AS a FROM hits WHERE owner = 0 GROUP BY ALL),
found AS (SELECT doc_id, topic, owner, list(raw ORDER BY place) AS u FROM hits WHERE owner > 0 GROUP BY ALL),
units AS (SELECT col0 AS topic, col1 AS owner, col2 AS unit_id, col3 AS unit_kind, col4 AS cluster_id, col5 AS tier FROM {_values(_UNITS)}),
tags AS (SELECT a.doc_id, a.topic AS topic_id, unit_id, unit_kind, cluster_id, tier, list_concat(a.a, coalesce(f.u, [])) AS matched, matched_on FROM anchors a LEFT JOIN found f ON f.doc_id = a.doc_id AND f.topic = a.topic JOIN units u ON u.topic = a.topic AND u.owner = coalesce(f.owner, 0))"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.substr("text", F.length(F.substring_index("text", ".", 1)) + 2).alias("rest"))
    return tagged(docs, PLAN, VERSION, key="doc_id", abstract="rest")


@query(f"WITH {_TAGS} SELECT doc_id, topic_id, unit_id, unit_kind, cluster_id, tier, array_to_string(matched, ' | ') AS matched_terms, matched_on, '{VERSION}' AS plan_version FROM tags")
def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the topics whose anchor stands in a title and whole text, with all that matched; topics without a unit are unassigned."""
    return _tagged(spark, sf_dir).withColumn("matched_terms", F.array_join("matched_terms", " | "))


@query(f"WITH {_TAGS} SELECT topic_id, unit_id, cluster_id, tier, count(DISTINCT doc_id) AS items, count(*) FILTER (WHERE matched_on = 'title_abstract') AS whole, max(len(matched)) AS most_terms FROM tags GROUP BY ALL")
def topic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each unit has; unassigned items are a unit of their topic."""
    return _tagged(spark, sf_dir).groupBy("topic_id", "unit_id", "cluster_id", "tier").agg(F.count_distinct("doc_id").alias("items"), F.count_if(F.col("matched_on") == "title_abstract").alias("whole"), F.max(F.size("matched_terms")).alias("most_terms"))
