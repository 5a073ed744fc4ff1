"""Standing gates over cases: every case with the first rule that decides it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import case_sql, code_table, codes_sql, rule_table
from ..operators import policy as P
from ..sources.tables import DESK_SQL, ITEMS_AS_OF, LOG_SQL, desk, load, log
from .registry import query

#: Cases stand in for what gates read, as SQL over the documents (i: their number).
_CASE = {
    "title": "concat(CASE i % 13 WHEN 0 THEN 'webinar on ' WHEN 1 THEN 'job: ' WHEN 2 THEN 'student ' WHEN 3 THEN 'exam ' WHEN 4 THEN 'committee ' WHEN 5 THEN 'tender ' WHEN 6 THEN 'professor ' ELSE '' END, lower(substr(text, 1, 40)))",
    "body": "CASE i % 6 WHEN 0 THEN 'for students' WHEN 1 THEN 'faculty and staff' ELSE lower(substr(text, 1, 200)) END",
    "native": "i % 17 = 0", "strong": "i % 4 % 3", "weak": "i % 3", "system": "i % 2 = 0", "congress": "i % 19 = 0", "excluded": "i % 7 = 0", "included": "i % 5 = 0", "opportunity": "i % 11 = 0",
    "path": "CASE i % 8 WHEN 0 THEN '/sport/a' ELSE '/health/b' END", "family": "CASE i % 5 WHEN 0 THEN 'health' WHEN 1 THEN 'education' WHEN 2 THEN 'career' ELSE 'sport' END", "official_queued": "i % 6 = 1",
    "claim": "CASE i % 10 WHEN 0 THEN 'guaranteed' WHEN 1 THEN 'agency' END", "url": "CASE WHEN i % 9 <> 0 THEN concat('https://x.org/', i) END", "stage": "CASE i % 4 WHEN 0 THEN 'exam' WHEN 1 THEN 'licence' WHEN 2 THEN 'placement' ELSE 'other' END",
    "country": "CASE i % 7 WHEN 0 THEN 'DE' WHEN 1 THEN 'UK' WHEN 2 THEN 'US' WHEN 3 THEN 'CH' WHEN 4 THEN 'FR' END", "watch": "i % 8 = 3", "named": "i % 2 = 1", "eligibility": "CASE WHEN i % 3 <> 0 THEN 'yes' END", "object_type": "CASE WHEN i % 5 <> 0 THEN 'pathway' ELSE 'other' END",
    "kind": "CASE i % 12 WHEN 0 THEN 'congress' WHEN 1 THEN 'ceremony' ELSE 'call' END", "curator": "i % 3 = 1", "official_url": "CASE WHEN i % 4 <> 1 THEN 'https://o.org' END", "missing": "i % 5 % 2", "verified": "i % 2 = 0",
    "retracted": "i % 23 = 0", "relevant": "i % 6 <> 5", "preprint": "i % 9 = 2", "design": "CASE i % 8 WHEN 0 THEN 'rct' WHEN 1 THEN 'cohort' WHEN 2 THEN 'case_report' WHEN 3 THEN 'animal' WHEN 4 THEN 'review' END", "limitations": "CASE WHEN i % 4 <> 0 THEN 'some' END", "primary_source": "i % 3 <> 2",
    "validation": "CASE i % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 2 THEN 'prospective' END", "source_class": "CASE i % 4 WHEN 0 THEN 'agency' WHEN 1 THEN 'journal' WHEN 2 THEN 'forum' ELSE 'advert' END", "question": "CASE WHEN i % 5 <> 1 THEN 'why' END", "audience": "CASE WHEN i % 7 <> 1 THEN 'students' END",
    "today": f"DATE '{ITEMS_AS_OF}'", "deadline": f"CASE WHEN i % 3 <> 0 THEN DATE '{ITEMS_AS_OF}' + CAST(i % 40 - 20 AS INTEGER) END", "published": f"CASE WHEN i % 5 <> 0 THEN DATE '{ITEMS_AS_OF}' - CAST(i % 60 AS INTEGER) END", "active": "i % 9 = 4",
    "token": "CASE i % 9 WHEN 0 THEN 'eligible' WHEN 1 THEN 'yes' WHEN 2 THEN 'not eligible' WHEN 3 THEN 'closed' WHEN 4 THEN '' WHEN 5 THEN 'n/a' WHEN 6 THEN 'maybe' END",
    "families": "i % 4", "frontier": "i % 3 = 0", "human": "i % 29 = 0", "grounded": "i % 6 <> 0", "refs": "i % 5", "novelty": "CAST(i % 100 AS DOUBLE) / 100",
    "feed": "CASE i % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END", "login": "CASE WHEN i % 11 = 0 THEN 'yes' ELSE 'no' END", "robots": "CASE WHEN i % 13 = 0 THEN 'deny' ELSE 'allow' END", "items": "i % 6", "error": "CASE WHEN i % 10 = 7 THEN 'broken' END",
}
_CASES_SQL = f"c AS (SELECT i, {', '.join(f'{e} AS {n}' for n, e in _CASE.items())} FROM (SELECT doc_id AS i, text FROM documents))"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id AS i", "text")
    return docs.selectExpr("i", *(f"{e} AS {n}" for n, e in _CASE.items()))


def _gate(name: str, rules: Sequence[tuple[str, str]], otherwise: str, doc: str) -> Callable[[SparkSession, str], DataFrame]:
    """Register a gate over the cases under a name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cases(spark, sf_dir).select("i", rule_table(rules, otherwise).alias("decision"))

    run.__name__, run.__doc__ = name, doc
    return query(f"WITH {_CASES_SQL} SELECT i, {case_sql(rules, otherwise)} AS decision FROM c")(run)


profession_gate = _gate("profession_gate", P.PROFESSION, "discard:none", "Whether an item concerns the profession: native sources, strong or several weak terms, or a weak one in the system layer.")
tip_item_gate = _gate("tip_item_gate", P.TIP_ITEM, "discard:no_signal", "Congress, exclusion, inclusion, opportunity and audience, in this order.")
agency_gate = _gate("agency_gate", P.AGENCY, "review", "News agencies: dropped, merged with a queued official item, or reviewed; never published by rule.")
abroad_gate = _gate("abroad_gate", P.ABROAD, "review", "Pathways abroad: claims, link, stage, jurisdiction, then what a named opportunity must state.")
opportunity_gate = _gate("opportunity_gate", P.OPPORTUNITY, "review", "Calls: ceremonies and expired ones go, curators need an official link.")
research_gate = _gate("research_gate", P.RESEARCH, "review", "Papers: retracted first, then relevance, preprints, designs and what must be stated.")
medical_ai_gate = _gate("medical_ai_gate", P.MEDICAL_AI, "watch", "Medical software by how it was validated; no rung is ready for patients.")
media_gate = _gate("media_gate", P.MEDIA, "hold:unverified", "Consumer media point to a verified primary source or go.")
trend_gate = _gate("trend_gate", P.TREND, "accept", "Trends from trusted classes with a primary source.")
demand_gate = _gate("demand_gate", P.DEMAND, "accept", "Questions that an audience asks.")
evidence_promotion = _gate("evidence_promotion", P.EVIDENCE, "promote", "What is complete enough to count as evidence.")
backfill_class = _gate("backfill_class", P.BACKFILL, "backfill_low", "How an old item is taken in later.")
eligibility_status = _gate("eligibility_status", P.ELIGIBILITY, "INVALID", "A status token in its one spelling; unknown ones are invalid.")
deadline_window = _gate("deadline_window", P.WINDOW, "unknown", "How an opportunity's window is called.")
promotion_route = _gate("promotion_route", P.PROMOTION, "none", "By which route a candidate is promoted: a person, convergence of families, or a frontier source.")
wow_status = _gate("wow_status", P.WOW, "dull", "Grounding before novelty.")
ingestability = _gate("ingestability", P.INGESTABLE, "UNKNOWN:not_probed", "Whether a source can be read, by tri-states of evidence in order.")


#: Feeds with the URL shapes that belong to their section.
SECTIONS = (("src1", "^https://x.org/1[0-9]*$"), ("src2", "^https://x.org/[0-9]*[02468]$"), ("src3", "^https://x.org/[0-9]{3}$"))


@query(f"WITH s AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in SECTIONS)}) t(source, shape)) SELECT doc_id, source, shape IS NULL OR regexp_matches(concat('https://x.org/', doc_id), shape) AS in_section FROM documents LEFT JOIN s USING (source)")
def url_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a link lies in its feed's section; feeds without a rule take all. The rules are a small constant table."""
    rules = F.broadcast(spark.createDataFrame(list(SECTIONS), "source string, shape string"))
    url = F.concat(F.lit("https://x.org/"), F.col("doc_id"))
    return load(spark, sf_dir, "documents").join(rules, "source", "left").select("doc_id", "source", (F.col("shape").isNull() | F.regexp_like(url, F.col("shape"))).alias("in_section"))


_SCAN = f"(toxic = 1 OR route = 'news' AND (channel LIKE 'grant%' OR fetched IS NULL) OR route = 'notice' AND channel = 'training' OR n_chars < 100)"


@query(f"WITH {DESK_SQL}, s AS (SELECT * FROM desk WHERE {_SCAN} ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, published DESC, item_id LIMIT 3000) SELECT item_id, {case_sql(P.LANE_SCAN)} AS decision FROM s ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, published DESC, item_id LIMIT 200")
def lane_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the purity scan: one compound filter, the most urgent 3,000, of which 200 decisions: both limits are the feature."""
    order = [F.when(F.col("toxic") == 1, 0).otherwise(1), F.desc("published"), F.col("item_id")]
    found = desk(spark, sf_dir).where(_SCAN).orderBy(*order).limit(3000)
    return found.orderBy(*order).limit(200).select("item_id", rule_table(P.LANE_SCAN).alias("decision"))


_HOST = {
    "url": "CASE i % 9 WHEN 0 THEN concat('http://10.0.0.', i % 250) WHEN 1 THEN 'http://user:pw@x.org/' WHEN 2 THEN concat('http://172.', 14 + i % 20, '.1.1/a') WHEN 3 THEN 'http://[::1]/x' WHEN 4 THEN concat('http://', 2130706433 + i, '/') WHEN 5 THEN 'https://x.org/a?api_key=1' WHEN 6 THEN 'http://printer.local/' WHEN 7 THEN concat('https://', i % 256, '.8.8.8/z') ELSE concat('https://x.org/', i) END",
    "host": "split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1)", "a": "CASE WHEN length(host) - length(replace(host, '.', '')) = 3 THEN TRY_CAST(split_part(host, '.', 1) AS INTEGER) END", "b": "CASE WHEN length(host) - length(replace(host, '.', '')) = 3 THEN TRY_CAST(split_part(host, '.', 2) AS INTEGER) END",
}


@query(f"WITH u AS (SELECT doc_id AS i, {_HOST['url'].replace('i %', 'doc_id %').replace(' i,', ' doc_id,').replace('+ i', '+ doc_id').replace(', i)', ', doc_id)')} AS url FROM documents), h AS (SELECT *, {_HOST['host']} AS host FROM u), p AS (SELECT *, {_HOST['a']} AS a, {_HOST['b']} AS b FROM h) SELECT i, {codes_sql(P.HOSTS)} AS codes FROM p")
def unsafe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that speaks against fetching a link: names and numbers of private hosts, in any notation, and secrets in it."""
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id AS i").selectExpr("i", f"{_HOST['url']} AS url")
    for name in ("host", "a", "b"):
        rows = rows.selectExpr("*", f"{_HOST[name]} AS {name}")
    return rows.select("i", code_table(P.HOSTS).alias("codes"))


_FETCH = {"status": "CASE k % 9 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 418 WHEN 5 THEN 204 END", "error": "CASE k % 5 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'bad certificate' WHEN 2 THEN 'getaddrinfo ENOTFOUND' WHEN 3 THEN 'cannot parse body' END"}


@query(f"WITH {LOG_SQL}, f AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _FETCH.items())} FROM log) SELECT event_id, {case_sql(P.FAILURE, 'unknown')} AS class FROM f")
def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of failure a fetch met, by its status, else by what the error says."""
    return log(spark, sf_dir).selectExpr("event_id", *(f"{e} AS {n}" for n, e in _FETCH.items())).select("event_id", rule_table(P.FAILURE, "unknown").alias("class"))


@query(f"WITH {LOG_SQL} SELECT event_id, {case_sql(P.SIGNAL_TIER, 'tier_4').replace('kind', 'event_type').replace('score', '(k * 1.0)')} AS tier FROM log")
def signal_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).selectExpr("event_id", "k * 1.0 AS score", "event_type AS kind").select("event_id", rule_table(P.SIGNAL_TIER, "tier_4").alias("tier"))
