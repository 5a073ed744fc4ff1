"""JSON answers of public literature and trial registries as one candidate form, natively parsed.

Each mapper takes rows with a JSON column and gives (source, external_id, doi, pmid, title, container,
published). Broken JSON gives no rows; missing fields are null; entries keep their order in ``position``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMAS = {
    "europe_pmc": "resultList struct<result: array<struct<id: string, pmid: string, doi: string, title: string, journalTitle: string, firstPublicationDate: string>>>",
    "crossref": "message struct<items: array<struct<DOI: string, title: array<string>, `container-title`: array<string>, issued: struct<`date-parts`: array<array<int>>>>>>",
    "openalex": "results array<struct<id: string, doi: string, title: string, publication_date: string, primary_location: struct<source: struct<display_name: string>>>>",
    "trials": "studies array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string>, statusModule: struct<studyFirstPostDateStruct: struct<date: string>, overallStatus: string>, conditionsModule: struct<conditions: array<string>>, armsInterventionsModule: struct<interventions: array<struct<type: string, name: string>>, armGroups: array<struct<type: string, interventionNames: array<string>>>>>>>",
}
#: Arm types of the registry that mark a control.
CONTROL_ARMS = ("PLACEBO_COMPARATOR", "SHAM_COMPARATOR", "NO_INTERVENTION")


def _entries(answers: DataFrame, json: str, kind: str, path: str) -> DataFrame:
    parsed = answers.select(F.from_json(json, _SCHEMAS[kind]).alias("a"))
    return parsed.select(F.posexplode(F.col(f"a.{path}")).alias("position", "e"))


def _bare_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", ""))


def _candidate(rows: DataFrame, source: str, external_id: Column, doi: Column, pmid: Column, title: Column, container: Column, published: Column) -> DataFrame:
    text = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select("position", F.lit(source).alias("source"), external_id.alias("external_id"), _bare_doi(doi).alias("doi"), pmid.cast("string").alias("pmid"), text(title).alias("title"), text(container).alias("container"), published.alias("published"))


def europe_pmc(answers: DataFrame, json: str = "json") -> DataFrame:
    e = F.col("e")
    return _candidate(_entries(answers, json, "europe_pmc", "resultList.result"), "europe_pmc", e["id"], e["doi"], e["pmid"], e["title"], e["journalTitle"], F.try_to_date(e["firstPublicationDate"], "yyyy-MM-dd"))


def crossref(answers: DataFrame, json: str = "json") -> DataFrame:
    e = F.col("e")
    part = lambda i: F.coalesce(F.get(F.get(e["issued"]["date-parts"], F.lit(0)), F.lit(i)), F.lit(1))
    year = F.get(F.get(e["issued"]["date-parts"], F.lit(0)), F.lit(0))
    published = F.when(year.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", year, part(1), part(2)), "yyyy-MM-dd"))
    return _candidate(_entries(answers, json, "crossref", "message.items"), "crossref", e["DOI"], e["DOI"], F.lit(None), F.get(e["title"], F.lit(0)), F.get(e["container-title"], F.lit(0)), published)


def openalex(answers: DataFrame, json: str = "json") -> DataFrame:
    e = F.col("e")
    return _candidate(_entries(answers, json, "openalex", "results"), "openalex", F.regexp_replace(e["id"], "^.*/", ""), e["doi"], F.lit(None), e["title"], e["primary_location"]["source"]["display_name"], F.try_to_date(e["publication_date"], "yyyy-MM-dd"))


def trial_signals(answers: DataFrame, json: str = "json") -> DataFrame:
    """(study_id, observed, family, label, role): one row for each condition and intervention of a study, the first of equal labels.

    Studies without an id or a first posting take no part. An intervention is a control if every arm that has it is a control arm.
    """
    s = F.col("e.protocolSection")
    rows = _entries(answers, json, "trials", "studies").select(s["identificationModule"]["nctId"].alias("study_id"), F.try_to_date(s["statusModule"]["studyFirstPostDateStruct"]["date"], "yyyy-MM-dd").alias("observed"), s["conditionsModule"]["conditions"].alias("conditions"), s["armsInterventionsModule"].alias("arms"))
    rows = rows.where((F.col("study_id") != "") & F.col("observed").isNotNull())
    bare = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^[A-Za-z ]+:\s*", "")))
    has = lambda arm, name: F.exists(F.coalesce(arm["interventionNames"], F.array().cast("array<string>")), lambda n: bare(n) == F.lower(F.trim(name)))
    own = F.filter(F.coalesce("arms.armGroups", F.array()), lambda arm: has(arm, F.col("label")))
    conditions = rows.select("study_id", "observed", "arms", F.posexplode("conditions").alias("position", "label")).withColumn("family", F.lit("condition"))
    treatments = rows.select("study_id", "observed", "arms", F.posexplode(F.transform("arms.interventions", lambda i: i["name"])).alias("position", "label")).withColumn("family", F.lit("intervention"))
    both = conditions.unionByName(treatments).where(F.trim("label") != "")
    control = (F.col("family") == "intervention") & (F.size(own) > 0) & F.forall(own, lambda arm: F.coalesce(arm["type"].isin(*CONTROL_ARMS), F.lit(False)))
    both = both.select("study_id", "observed", "family", F.trim("label").alias("label"), F.when(control, "control").otherwise("topic").alias("role"), "position", F.lower(F.trim("label")).alias("key"))
    first = both.groupBy("study_id", "family", "key").agg(F.min(F.struct("position", "label", "role", "observed")).alias("f"))
    return first.select("study_id", F.col("f.observed").alias("observed"), "family", F.col("f.label").alias("label"), F.col("f.role").alias("role"))


def enrich(candidates: DataFrame, metrics: DataFrame, key: str = "pmid") -> DataFrame:
    """Candidates with the columns of a metrics table by key; those without keep nulls, and equal keys of the metrics count once."""
    one = metrics.where(F.col(key).isNotNull()).dropDuplicates([key])
    return candidates.join(one, key, "left")


def pubmed(answers: DataFrame, json: str = "json") -> DataFrame:
    """Summaries of a literature search: a map by identifier, whose list of identifiers gives the order."""
    uids = F.from_json(F.get_json_object(json, "$.result.uids"), "array<string>")
    rows = answers.select(F.posexplode(uids).alias("position", "pmid"), F.from_json(F.get_json_object(json, "$.result"), "map<string,string>").alias("m")).withColumn("e", F.try_element_at("m", F.col("pmid")))
    part = lambda name: F.get_json_object("e", f"$.{name}")
    return _candidate(rows, "pubmed", F.col("pmid"), F.get_json_object("e", "$.elocationid"), F.col("pmid"), part("title"), part("fulljournalname"), F.try_to_date(F.left(part("sortpubdate"), F.lit(10)), "yyyy/MM/dd"))


def icite(answers: DataFrame, json: str = "json") -> DataFrame:
    """(pmid, citations, percentile) of a citation service's answer, for ``enrich``."""
    rows = answers.select(F.explode(F.from_json(F.get_json_object(json, "$.data"), "array<struct<pmid:long,citation_count:long,nih_percentile:double>>")).alias("e"))
    return rows.select(F.col("e.pmid").cast("string").alias("pmid"), F.col("e.citation_count").alias("citations"), F.col("e.nih_percentile").alias("percentile"))


def gdelt(answers: DataFrame, json: str = "json") -> DataFrame:
    rows = answers.select(F.posexplode(F.from_json(F.get_json_object(json, "$.articles"), "array<struct<url:string,title:string,domain:string,seendate:string>>")).alias("position", "e"))
    e = F.col("e")
    return _candidate(rows, "gdelt", e["url"], F.lit(None), F.lit(None), e["title"], e["domain"], F.try_to_date(F.left(e["seendate"], F.lit(8)), "yyyyMMdd"))


def pmc_open(answers: DataFrame, xml: str = "xml") -> DataFrame:
    """Records of an open-access list in XML."""
    rows = answers.select(F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)(<record\b.*?</record>)"), 1)).alias("position", "r"))
    attribute = lambda name: F.regexp_extract("r", rf'{name}="([^"]*)"', 1)
    return _candidate(rows, "pmc_oa", attribute("id"), F.lit(None), F.lit(None), attribute("citation"), F.regexp_extract(attribute("citation"), r"^([^.]*)\.", 1), F.try_to_date(F.left(attribute("updated"), F.lit(10)), "yyyy-MM-dd"))


def who_news(answers: DataFrame, json: str = "json") -> DataFrame:
    rows = answers.select(F.posexplode(F.from_json(F.get_json_object(json, "$.value"), "array<struct<UrlName:string,Title:string,PublicationDateAndTime:string,NewsType:string>>")).alias("position", "e"))
    e = F.col("e")
    return _candidate(rows, "who", e["UrlName"], F.lit(None), F.lit(None), e["Title"], e["NewsType"], F.try_to_date(F.left(e["PublicationDateAndTime"], F.lit(10)), "yyyy-MM-dd"))


def least_recent(apis: DataFrame) -> DataFrame:
    """The one source (source, last_run) whose turn it is: never run before run, then the one that ran longest ago."""
    return apis.orderBy(F.col("last_run").asc_nulls_first(), "source").limit(1)


def journal_works(works: DataFrame, container: str, since: str, until: str) -> DataFrame:
    """Candidates of exactly this journal (letters and digits alone) within a window of days: a search by name returns neighbours too."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return works.where((bare(F.col("container")) == bare(F.lit(container))) & F.col("published").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def pushed(rows: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) rows of a push (key, title, url, published): JSON that can't be read, or lacks key or title, is refused with its reason."""
    e = F.from_json(json, "struct<key:string,title:string,url:string,published:string>")
    read = rows.select(F.col(json).alias("raw"), e.alias("e"))
    reason = F.when(F.coalesce("e.key", F.lit("")) == "", "no_key").when(F.length(F.trim(F.coalesce("e.title", F.lit("")))) < 3, "no_title").when(F.col("e.published").isNotNull() & F.try_to_date(F.left("e.published", F.lit(10)), "yyyy-MM-dd").isNull(), "bad_day")
    read = read.withColumn("reason", reason)
    good = read.where("reason is null").groupBy("e.key").agg(F.min(F.struct("raw", "e")).alias("f"))
    return good.select("key", "f.e.title", "f.e.url", F.try_to_date(F.left("f.e.published", F.lit(10)), "yyyy-MM-dd").alias("published")), read.where("reason is not null").select("raw", "reason")


def connector_run(planned: DataFrame, normalise, most: int, valid: str) -> DataFrame:
    """A connector's run: what it planned, normalised row by row, the first ``most`` by position (a run's cap is part of its plan), and only valid ones."""
    return normalise(planned).orderBy("position").limit(most).where(valid)
