"""Full evaluations: admission, sources, releases, cells, topics, model heads and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import case_sql, code_table, codes_sql, rule_table
from ..operators.latest import winner
from ..sources.tables import DESK_SQL, EVENTS_AS_OF, ITEMS_AS_OF, LOG_SQL, VERSIONS_SQL, desk, load, log, versions
from .registry import query
from .texts import _FOLDED, _TOKENS, BUCKETS, _features

#: All nine rules of admission, over desk items.
ADMISSION = (
    ("placeholder_title", "title LIKE 'untitled%' OR title LIKE 'test%' OR title = ''"), ("passed", "channel = 'grants' AND length(title) >= 8"), ("short_title", "length(trim(title)) < 12"), ("source_policy", "source_id IN ('src3', 'src7') AND title NOT LIKE '%the%'"),
    ("invalid_date", "fetched < published"), ("undated", "route = 'news' AND fetched IS NULL"), ("future_date", f"published > DATE '{ITEMS_AS_OF}'"), ("stale", f"published < DATE '{ITEMS_AS_OF}' - INTERVAL '300' DAY AND route = 'news' OR published < DATE '{ITEMS_AS_OF}' - INTERVAL '390' DAY"), ("off_topic", "route IS NULL"),
)


@query(f"WITH {DESK_SQL} SELECT item_id, {case_sql(ADMISSION, 'admitted')} AS reason FROM desk")
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the first of the nine rules that decides it; refused rows stay, with their reason."""
    return desk(spark, sf_dir).select("item_id", rule_table(ADMISSION, "admitted").alias("reason"))


#: Per source: what must not stand in a text, what must, and what must all stand there; texts are tried raw and folded.
POLICIES = (("src1", "deny", "licensed"), ("src2", "allow", "that"), ("src2", "allow", "les"), ("src4", "all", "the"), ("src4", "all", "and"), ("src5", "deny", "token"), ("src5", "allow", "e"), ("src6", "deny", "THE"))
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in POLICIES)


@query(f"""WITH p AS (SELECT * FROM (VALUES {_VALUES}) t(source, kind, term)), h AS (SELECT doc_id, kind, contains(text, term) OR contains({_FOLDED % "text"}, term) AS hit FROM documents JOIN p USING (source)),
 g AS (SELECT doc_id, coalesce(bool_or(hit) FILTER (WHERE kind = 'deny'), false) AS denied, bool_or(hit) FILTER (WHERE kind = 'allow') AS allowed, bool_and(hit) FILTER (WHERE kind = 'all') AS complete FROM h GROUP BY 1)
SELECT doc_id, CASE WHEN denied THEN 'denied' WHEN NOT allowed THEN 'not_allowed' WHEN NOT complete THEN 'incomplete' ELSE 'passed' END AS verdict FROM documents LEFT JOIN g USING (doc_id)""")
def content_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's policy says of its texts: deny wins, then allow, then all. The policies are one constant map, so texts are not shuffled."""
    t, folded = F.col("text"), T.fold(F.col("text"))

    def terms(kind: str) -> Column:
        by = {}
        for source, k, term in POLICIES:
            if k == kind:
                by.setdefault(source, []).append(term)
        entries = [x for source, some in by.items() for x in (F.lit(source), F.array(*(F.lit(v) for v in some)))]
        return F.try_element_at(F.create_map(*entries), F.col("source"))

    held = lambda x: t.contains(x) | F.col("folded").contains(x)
    denied, allowed, complete = F.exists(terms("deny"), held), F.exists(terms("allow"), held), F.forall(terms("all"), held)
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text", folded.alias("folded"))
    return docs.select("doc_id", F.when(denied, "denied").when(~allowed, "not_allowed").when(~complete, "incomplete").otherwise("passed").alias("verdict"))


#: Parts of a source's score with their caps, and what overrides it.
PARTS = (("yield_", 40, "purchases * 3.0"), ("freshness", 20, "CASE WHEN late_days < 2 THEN 20.0 WHEN late_days < 6 THEN 10.0 ELSE 0.0 END"), ("variety", 15, "kinds * 3.0"), ("volume", 25, "CASE WHEN n >= 20 THEN n / 4.0 END"))
_RAW = ", ".join(f"{e} AS {n}" for n, _, e in PARTS)
_GOT = " + ".join(f"coalesce(greatest(0.0, least({n}, {c}.0)), 0.0)" for n, c, _ in PARTS)
_CAP = " + ".join(f"CASE WHEN {n} IS NULL THEN 0.0 ELSE {c}.0 END" for n, c, _ in PARTS)
VERDICT = (("fail:banned", "user_id % 31 = 0"), ("technical", "errors >= 40"), ("pass", "score >= 70"), ("watch", "score >= 45"))
LIFECYCLE = (("retire", "verdict = 'fail:banned'"), ("repair", "verdict = 'technical'"), ("probation", "verdict = 'fail'"), ("observe", "verdict = 'watch'"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, date_diff('day', max(day), DATE '{EVENTS_AS_OF}') AS late_days FROM log GROUP BY user_id),
 p AS (SELECT *, {_RAW} FROM s), c AS (SELECT *, round(100.0 * ({_GOT}) / ({_CAP}), 4) AS score FROM p), v AS (SELECT *, {case_sql(VERDICT, 'fail')} AS verdict FROM c) SELECT user_id, CAST(score AS DOUBLE) AS score, verdict, {case_sql(LIFECYCLE, 'keep')} AS lifecycle FROM v""")
def source_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score over the parts that are there, each within its cap; bans override it, technical trouble never fails a source, and the lifecycle follows."""
    s = log(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"), F.datediff(F.lit(EVENTS_AS_OF).cast("date"), F.max("day")).alias("late_days"))
    c = s.selectExpr("*", *(f"{e} AS {n}" for n, _, e in PARTS)).selectExpr("*", f"CAST(round(100.0 * ({_GOT}) / ({_CAP}), 4) AS DOUBLE) AS score")
    v = c.withColumn("verdict", rule_table(VERDICT, "fail"))
    return v.select("user_id", "score", "verdict", rule_table(LIFECYCLE, "keep").alias("lifecycle"))


@query(f"""WITH {VERSIONS_SQL}, c AS (SELECT series_id, period, max(release_rank) AS r, arg_max(value, (release_rank, release_id, line)) AS v FROM versions WHERE release_id % 2 = 0 GROUP BY ALL), p AS (SELECT series_id, period, max(release_rank) AS r, arg_max(value, (release_rank, release_id, line)) AS v FROM versions WHERE release_id % 2 = 1 GROUP BY ALL), m AS (SELECT series_id, max(period) AS newest FROM p GROUP BY 1)
SELECT series_id, period, CASE WHEN c.r IS NULL THEN 'MISSING' WHEN newest IS NULL THEN 'NEW_CAUSE' WHEN p.r IS NULL AND period > newest THEN 'NEW_YEAR' WHEN p.r IS NULL OR c.r < p.r THEN 'LATE_OLDER' WHEN c.r = p.r AND c.v <> p.v THEN 'CONFLICT' WHEN c.r = p.r THEN 'UNCHANGED' WHEN c.v = p.v THEN 'CONFIRMED' ELSE 'REVISED' END AS class FROM c FULL JOIN p USING (series_id, period) LEFT JOIN m USING (series_id)""")
def release_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight ways in which a release can stand to the one before, cell by cell."""
    v = versions(spark, sf_dir).withColumn("r", F.col("release_rank"))
    side = lambda odd, name: winner(v.where(F.col("release_id") % 2 == odd), ["series_id", "period"], ["release_rank", "release_id", "line"], ["r", "value"]).select("series_id", "period", F.col("r").alias(f"{name}r"), F.col("value").alias(f"{name}v"))
    c, p = side(0, "c"), side(1, "p")
    m = p.groupBy("series_id").agg(F.max("period").alias("newest"))
    rows = c.join(p, ["series_id", "period"], "full_outer").join(m, "series_id", "left")
    rules = (("MISSING", "cr IS NULL"), ("NEW_CAUSE", "newest IS NULL"), ("NEW_YEAR", "pr IS NULL AND period > newest"), ("LATE_OLDER", "pr IS NULL OR cr < pr"), ("CONFLICT", "cr = pr AND cv <> pv"), ("UNCHANGED", "cr = pr"), ("CONFIRMED", "cv = pv"))
    return rows.select("series_id", "period", rule_table(rules, "REVISED").alias("class"))


@query(f"""WITH {VERSIONS_SQL}, v AS (SELECT series_id, period, release_rank, CASE WHEN quantity > 5 THEN value END AS value, flag FROM versions), r AS (SELECT series_id, period, release_rank, count(DISTINCT (value, flag)) AS kinds, count(value) AS n, max(value) AS value FROM v GROUP BY ALL), t AS (SELECT series_id, period, arg_max(r, release_rank) AS r FROM r GROUP BY ALL)
SELECT series_id, period, CASE WHEN r.n = 0 THEN 'WITHDRAWN' WHEN r.kinds > 1 THEN 'AMBIGUOUS' ELSE 'EFFECTIVE' END AS state, CASE WHEN r.n > 0 AND r.kinds = 1 THEN r.value END AS value FROM t""")
def effective_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell by its newest release: without a value it withdraws the cell, with several it is ambiguous. Two aggregates, no window."""
    v = versions(spark, sf_dir).select("series_id", "period", "release_rank", F.when(F.col("quantity") > 5, F.col("value")).alias("value"), "flag")
    kinds = F.size(F.collect_set(F.struct("value", "flag")))  # versions of one cell in one release
    r = v.groupBy("series_id", "period", "release_rank").agg(kinds.alias("kinds"), F.count("value").alias("n"), F.max("value").alias("value"))
    t = r.groupBy("series_id", "period").agg(F.max(F.struct("release_rank", "kinds", "n", "value")).alias("r"))
    state = F.when(F.col("r.n") == 0, "WITHDRAWN").when(F.col("r.kinds") > 1, "AMBIGUOUS").otherwise("EFFECTIVE")
    return t.select("series_id", "period", state.alias("state"), F.when(state == "EFFECTIVE", F.col("r.value")).alias("value"))


HEADS = ("relevance", "novelty", "evidence", "reach")
_Z = ", ".join(f"1 / (1 + exp(-sum(sin(b * {0.31 + 0.02 * i:.2f}) * 0.2))) AS {h}" for i, h in enumerate(HEADS))
_U = " + ".join(f"4 * {h} * (1 - {h})" for h in HEADS)


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS % "text"} AS w FROM documents), f AS (SELECT doc_id, list_distinct(list_transform(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), lambda x: CAST('0x' || right(md5(x), 3) AS BIGINT))) AS b FROM t), u AS (SELECT doc_id, unnest(b) AS b FROM f), z AS (SELECT doc_id, {_Z} FROM u GROUP BY doc_id)
SELECT doc_id, {', '.join(f'round({h}, 6) AS {h}' for h in HEADS)}, round(({_U}) / 4, 6) AS uncertainty FROM z""")
def four_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four logistic heads over one pass of hashed features, and how uncertain they are together; weights are a table of 4,096 rows."""
    weights = spark.range(BUCKETS).select(F.col("id").alias("bucket"), *((F.sin(F.col("id") * F.lit(round(0.31 + 0.02 * i, 2))) * 0.2).alias(h) for i, h in enumerate(HEADS)))
    z = _features(load(spark, sf_dir, "documents")).join(F.broadcast(weights), "bucket").groupBy("doc_id").agg(*((1 / (1 + F.exp(-F.sum(h)))).alias(h) for h in HEADS))
    doubt = sum((4 * F.col(h) * (1 - F.col(h)) for h in HEADS), F.lit(0.0)) / len(HEADS)
    return z.select("doc_id", *(F.round(h, 6).alias(h) for h in HEADS), F.round(doubt, 6).alias("uncertainty"))


#: Flags of a text, and the gates that stop it, in order.
FLAGS = tuple((n, f"text LIKE '{p}'") for n, p in (
    ("link", "%http%"), ("mail", "%@%"), ("table", "%|%|%"), ("shout", "%!!%"), ("question", "%?%"), ("quote", "%\"%"), ("bracket", "%(%)%"), ("percent", "%\\%%"), ("money", "%$%"), ("colon", "%:%"), ("semicolon", "%;%"), ("dash", "% - %"), ("slash", "%/%"),
    ("licence", "%licensed%"), ("rights", "%All rights reserved%"), ("released", "%Released under%"), ("secret", "%token%"), ("password", "%password%"), ("key", "%AKIA%"), ("insult", "%stupid%"), ("year", "%20__%"), ("lines", "%\n%\n%"), ("list", "%\n- %"),
) if "\\" not in p) + (("long", "length(text) > 5000"),)
GATES = (("secret", "text LIKE '%password%' OR text LIKE '%AKIA%'"), ("insult", "text LIKE '%stupid%' OR text LIKE '%idiot%'"), ("boilerplate", "text LIKE '%All rights reserved%'"), ("table", "text LIKE '%|%|%|%|%'"), ("shout", "text LIKE '%!!!%'"), ("empty", "length(trim(text)) < 10"), ("licence", "text LIKE '%licensed under%'"), ("too_long", "length(text) > 15000"))


@query(f"SELECT doc_id, {codes_sql(FLAGS)} AS flags, {case_sql(GATES, 'pass')} AS gate FROM documents")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of a text by name, and the first of eight gates that stops it; one projection."""
    return load(spark, sf_dir, "documents").select("doc_id", code_table(FLAGS).alias("flags"), rule_table(GATES, "pass").alias("gate"))


#: Ten states of a configured source, and the gates of activation with the state that follows.
STATES = (("RETIRED", "acctbal < -500"), ("MANUAL", "suppkey % 13 = 0"), ("NOT_WIRED", "suppkey % 11 = 0"), ("EVERGREEN_ONLY", "suppkey % 7 = 0"), ("NEVER_RUN", "n IS NULL"), ("DEGRADED", "returned > 0.4 * n"), ("OVERDUE", "late > 60"), ("NOT_DUE", "late < 10"), ("HEALTHY_EMPTY", "n < 300"))
ACTIVATION = (
    ("no_runs", "n IS NULL"), ("few_runs", "n < 50"), ("overdue", "late > 90"), ("returns", "returned > 0.35 * n"), ("balance", "acctbal < 0"), ("no_country", "nationkey IS NULL"), ("blocked_country", "nationkey IN (3, 4)"), ("name", "length(name) < 5"), ("small", "quantity < 1000"), ("discounts", "discount > 0.06"), ("parts", "parts < 20"),
)
_SUPPLY = "o AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-12-31') AS late, sum(l_quantity) AS quantity, avg(l_discount) AS discount, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1), s AS (SELECT s_suppkey AS suppkey, s_name AS name, s_acctbal AS acctbal, s_nationkey AS nationkey, o.* FROM supplier LEFT JOIN o ON l_suppkey = s_suppkey)"


@query(f"WITH {_SUPPLY} SELECT suppkey, {case_sql(STATES, 'HEALTHY')} AS state, {codes_sql(ACTIVATION)} AS failures, CASE WHEN suppkey % 17 = 0 OR acctbal < 0 THEN 'BLOCKED' WHEN {codes_sql(ACTIVATION)} = '' THEN 'AUTOMATION_READY' ELSE 'MANUAL_INTAKE' END AS activation FROM s")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured source in one of ten states, with all eleven gates that it fails; blocked ones first, ready ones only without a failure."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    o = l.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.datediff(F.lit("2001-12-31").cast("date"), F.to_date(F.max("l_shipdate"))).alias("late"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.countDistinct("l_partkey").alias("parts"))
    s = load(spark, sf_dir, "supplier").join(o, "s_suppkey", "left").selectExpr("s_suppkey AS suppkey", "s_name AS name", "s_acctbal AS acctbal", "s_nationkey AS nationkey", "n", "returned", "late", "quantity", "discount", "parts")
    s = s.select("suppkey", "acctbal", rule_table(STATES, "HEALTHY").alias("state"), code_table(ACTIVATION).alias("failures"))
    activation = F.when((F.col("suppkey") % 17 == 0) | (F.col("acctbal") < 0), "BLOCKED").when(F.col("failures") == "", "AUTOMATION_READY").otherwise("MANUAL_INTAKE")
    return s.select("suppkey", "state", "failures", activation.alias("activation"))


#: Ordered rules of revalidation over a source's figures.
REVALIDATION = (("retired", "user_id % 29 = 0"), ("conflict", "kinds >= 5 AND errors > purchases * 2"), ("failing", "streak >= 3"), ("overdue", "late_days >= 9"), ("never_run", "n = 0"), ("small_sample", "n < 10"), ("reject", "errors >= 0.5 * n"), ("watch", "errors >= 0.3 * n"))


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM log), s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, date_diff('day', max(day), DATE '{EVENTS_AS_OF}') AS late_days, count(*) FILTER (WHERE broken = 0) AS streak FROM m GROUP BY user_id)
SELECT user_id, {case_sql(REVALIDATION, 'keep')} AS recommendation, errors AS rejected, purchases AS accepted FROM s""")
def revalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of eight rules that holds for a source, over figures that combine on the map side."""
    from ..operators.latest import leading_streak

    rows = log(spark, sf_dir)
    kind = F.col("event_type")
    s = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "purchase").alias("purchases"), F.count_if(kind == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"), F.datediff(F.lit(EVENTS_AS_OF).cast("date"), F.max("day")).alias("late_days"))
    streak = leading_streak(rows, ["user_id"], ["ts", "event_id"], kind != "error")
    return s.join(streak, "user_id").select("user_id", rule_table(REVALIDATION, "keep").alias("recommendation"), F.col("errors").alias("rejected"), F.col("purchases").alias("accepted"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT user_id % 20 AS channel, event_type, k % 4 AS reason, count(*) AS n FROM log WHERE day > DATE '{EVENTS_AS_OF}' - 30 GROUP BY ALL), t AS (SELECT channel, arg_max(reason, (n, -reason)) AS top_reason, max(n) AS top_n FROM r WHERE event_type = 'error' GROUP BY 1)
SELECT channel, CAST(coalesce(sum(n) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS rejected, CAST(coalesce(sum(n) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS accepted, top_reason, top_n FROM r LEFT JOIN t USING (channel) GROUP BY channel, top_reason, top_n""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days of review by channel with the commonest reason to reject, the least one among equals."""
    rows = log(spark, sf_dir).where(F.col("day") > F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), 30))
    r = rows.groupBy((F.col("user_id") % 20).alias("channel"), "event_type", (F.col("k") % 4).alias("reason")).agg(F.count("*").alias("n"))
    is_ = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("n"))), F.lit(0))
    top = F.max(F.when(F.col("event_type") == "error", F.struct("n", (-F.col("reason")).alias("least"))))
    g = r.groupBy("channel").agg(is_("error").alias("rejected"), is_("purchase").alias("accepted"), top.alias("t"))
    return g.select("channel", "rejected", "accepted", (-F.col("t.least")).alias("top_reason"), F.col("t.n").alias("top_n"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT user_id, event_type AS family, k % 5 AS rank, max(day) AS last, count(*) FILTER (WHERE event_type = 'error') AS leases FROM log GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank, last, user_id) AS place FROM c WHERE last <= DATE '{EVENTS_AS_OF}' - 3 AND leases < 5)
SELECT user_id, family, rank, last FROM d WHERE place <= CASE family WHEN 'purchase' THEN 20 WHEN 'view' THEN 10 ELSE 5 END""")
def evergreen_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next run takes of each family within its share of the budget: past the cooldown, without a lease, best rank and oldest first."""
    c = log(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("family"), (F.col("k") % 5).alias("rank")).agg(F.max("day").alias("last"), F.count_if(F.col("event_type") == "error").alias("leases"))
    due = c.where((F.col("last") <= F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), 3)) & (F.col("leases") < 5))
    place = F.row_number().over(Window.partitionBy("family").orderBy("rank", "last", "user_id"))
    share = F.when(F.col("family") == "purchase", 20).when(F.col("family") == "view", 10).otherwise(5)
    return due.withColumn("place", place).where("place <= 20").where(F.col("place") <= share).select("user_id", "family", "rank", "last")
