"""Gates over titles and whole texts, with the words that decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_gates as G
from ..sources.tables import load
from .registry import query

#: Families and markers in the words of the tables' texts; the standing tables are tested on hand-made cases.
FAMILIES: G.Families = (("place", ("erthnd", r"thand\w*", "wh and")), ("people", ("sich", "der die", "unge?")), ("rules", ("les des", r"qui\w+", "ción")), ("wow", ("ouou", "onon", "enen", "rrr?")))
WORDS = G.TierWords(
    title=(("out", "title_first", ("erst",)), ("C", "title_second", ("onthe", "ungder")), ("out", "title_third", ("lesdes",))),
    licensure=("thther", "dieund", "quela"), exam=r"(?<![a-z0-9])ther(?![a-z0-9])|und der", excluded=("andand", "lele", "wast"), student=("anthe", "der die", "que la", "thon"),
    shapes=(r"(?<![a-z0-9])ther(?![a-z0-9])|und der", r"(?<![a-z])ed(?!a)"), context=("enen", "lich"), noise=("ouou", "rr"),
)


@query(r"""WITH f AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(erthnd|thand\w*|wh and)\b', 1), lambda x: lower(x))) AS place, list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(sich|der die|unge?)\b', 1), lambda x: lower(x))) AS people,
 list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(les des|qui\w+|ción)\b', 1), lambda x: lower(x))) AS rules, list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(ouou|onon|enen|rrr?)\b', 1), lambda x: lower(x))) AS wow FROM documents),
r AS (SELECT doc_id, unnest([['place', array_to_string(list_sort(place), ',')], ['people', array_to_string(list_sort(people), ',')], ['rules', array_to_string(list_sort(rules), ',')], ['wow', array_to_string(list_sort(wow), ',')], ['no_audience_fit', '']]) AS x, unnest(range(5)) AS place FROM f)
SELECT doc_id, x[1] <> 'no_audience_fit' AS ok, x[1] AS reason, x[2] AS terms FROM r WHERE x[2] <> '' OR x[1] = 'no_audience_fit' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1""")
def audience_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a text addresses: the first of four families with a word in it, and all of its words there."""
    x = G.family_fit(F.col("text"), FAMILIES)
    return load(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.ok", "x.reason", F.array_join(F.array_sort("x.terms"), ",").alias("terms"))


@query(r"""WITH p AS (SELECT doc_id, translate(split_part(text, '.', 1), 'ıİIşŞğĞüÜöÖçÇ', 'iiissgguuoocc') AS h, translate(text, 'ıİIşŞğĞüÜöÖçÇ', 'iiissgguuoocc') AS t FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(lower(h), '[ \t\n\r]+', ' ', 'g')) AS h, ' ' || trim(regexp_replace(lower(t), '[ \t\n\r]+', ' ', 'g')) || ' ' AS t FROM p),
s AS (SELECT *, [regexp_extract(t, '[^a-z0-9](ther)[^a-z0-9]', 1), CASE WHEN contains(t, 'und der') THEN 'und der' ELSE '' END] AS exam, [m FOR m IN ['anthe', 'der die', 'que la', 'thon'] IF contains(t, m)] AS student, regexp_matches(t, '[^a-z]ed[^a]') AS ed FROM n),
e AS (SELECT *, exam[1] <> '' OR exam[2] <> '' AS named FROM s)
SELECT doc_id, CASE WHEN trim(t) = '' OR contains(h, 'erst') THEN 'out' WHEN contains(h, 'onthe') OR contains(h, 'ungder') THEN 'C' WHEN contains(h, 'lesdes') THEN 'out' WHEN NOT named AND (contains(t, 'thther') OR contains(t, 'dieund') OR contains(t, 'quela')) THEN 'C'
 WHEN (contains(t, 'andand') OR contains(t, 'lele') OR contains(t, 'wast')) AND NOT (len(student) > 0 OR named OR ed) THEN 'out' WHEN contains(t, 'enen') OR contains(t, 'lich') THEN 'B' WHEN len(student) > 0 OR named OR ed THEN 'A' ELSE 'out' END AS tier,
 CASE WHEN trim(t) = '' THEN 'empty' WHEN contains(h, 'erst') THEN 'title_first' WHEN contains(h, 'onthe') OR contains(h, 'ungder') THEN 'title_second' WHEN contains(h, 'lesdes') THEN 'title_third' WHEN NOT named AND (contains(t, 'thther') OR contains(t, 'dieund') OR contains(t, 'quela')) THEN 'foreign_licensure'
 WHEN (contains(t, 'andand') OR contains(t, 'lele') OR contains(t, 'wast')) AND NOT (len(student) > 0 OR named OR ed) THEN 'non_student_cadre' WHEN contains(t, 'enen') OR contains(t, 'lich') THEN 'intern_context' WHEN len(student) > 0 OR named OR ed THEN 'student_agenda' WHEN contains(t, 'ouou') OR contains(t, 'rr') THEN 'admin_noise' ELSE 'no_student_signal' END AS reason FROM e""")
def student_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and reason of every text: titles before whole texts, licences elsewhere, cadres, the intern's context, the student's agenda, noise."""
    x = G.text_tier(F.split_part("text", F.lit("."), F.lit(1)), F.col("text"), WORDS)
    return load(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.tier", "x.reason")


@query("""WITH t AS (SELECT doc_id, translate(lower(text), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS t FROM documents) SELECT doc_id, len([m FOR m IN ['ther', 'cion', 'mente', 'ungs', 'quell'] IF contains(t, m)]) > 0 AS relevant, array_to_string([m FOR m IN ['cion', 'mente', 'quell', 'ther', 'ungs'] IF contains(t, m)], ',') AS terms FROM t""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a folded text holds a beginning of a word of the domain, and which."""
    x = G.relevant(F.lit(""), F.col("text"), ("ther", "cion", "mente", "ungs", "quell"))
    return load(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.relevant", F.array_join(F.array_sort("x.terms"), ",").alias("terms"))
