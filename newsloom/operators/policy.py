"""Gates as rule tables: (name, SQL condition over the row's columns), first match wins. Each says which columns it reads.

Conditions keep to SQL that every engine reads alike; a null condition does not hold. Callers may pass tables of their own to
``rule_table``; these are the standing ones.
"""

from __future__ import annotations

#: native, strong (terms), weak (terms), system (layer): whether an item concerns the profession.
PROFESSION = (("accept:native", "native"), ("accept:strong", "strong >= 1"), ("accept:weak_pair", "weak >= 2"), ("accept:system", "weak = 1 AND system"), ("discard:weak", "weak = 1"))
#: congress, excluded, included, opportunity, native, strong, weak, system: the item classifier's five steps.
TIP_ITEM = (("discard:congress", "congress"), ("discard:excluded", "excluded"), ("accept:included", "included"), ("accept:opportunity", "opportunity"), ("accept:audience", "native OR strong >= 1 OR weak >= 2"))
#: agency items are never published without review: path, excluded, family, official_queued.
AGENCY = (("discard:path", "path LIKE '/sport%'"), ("discard:keyword", "excluded"), ("discard:family", "family NOT IN ('health', 'education', 'career')"), ("merge:official", "official_queued"))
#: claim, url, stage, country, watch, named, eligibility, deadline, object_type.
ABROAD = (
    ("discard:auto_accept_claim", "claim = 'guaranteed'"), ("discard:pattern", "claim = 'agency'"), ("hold:no_url", "url IS NULL"), ("hold:unknown_stage", "stage NOT IN ('exam', 'licence', 'placement')"),
    ("hold:no_jurisdiction", "country IS NULL OR country NOT IN ('DE', 'UK', 'US', 'CH')"), ("watch", "watch"), ("hold:incomplete", "named AND (eligibility IS NULL OR deadline IS NULL)"), ("accept:opportunity", "named"), ("accept:pathway", "object_type = 'pathway'"),
)
#: kind, curator, official_url, deadline, today, missing, verified.
OPPORTUNITY = (("discard:congress", "kind = 'congress'"), ("discard:ceremony", "kind = 'ceremony'"), ("hold:no_official_link", "curator AND official_url IS NULL"), ("discard:expired", "deadline < today"), ("hold:missing", "missing > 0"), ("accept:official", "verified"))
#: retracted, relevant, preprint, design, limitations, primary_source.
RESEARCH = (
    ("discard:retracted", "retracted"), ("discard:irrelevant", "NOT relevant"), ("watch:preprint", "preprint"), ("watch:design", "design IN ('case_report', 'animal', 'in_vitro')"), ("hold:limitations", "limitations IS NULL"),
    ("hold:primary", "NOT primary_source"), ("hold:unknown_design", "design IS NULL"), ("review:trial", "design = 'rct'"),
)
#: A ladder of validation for medical software, which is never ready for patients; and media that only point to a verified source.
MEDICAL_AI = (("discard:claim", "claim = 'guaranteed'"), ("watch:internal", "validation = 'internal'"), ("review:external", "validation = 'external'"), ("review:prospective", "validation = 'prospective'"))
MEDIA = (("discard:no_primary", "NOT primary_source"), ("hold:unverified", "NOT verified"), ("discovery_only", "verified"))
#: source_class, primary_source; demand, question, audience; limitations, verified, design.
TREND = (("discard:class", "source_class NOT IN ('agency', 'journal')"), ("hold:primary", "NOT primary_source"))
DEMAND = (("discard:class", "source_class = 'advert'"), ("hold:question", "question IS NULL"), ("hold:audience", "audience IS NULL"))
EVIDENCE = (("hold:primary", "NOT primary_source"), ("hold:design", "design IS NULL"), ("hold:limitations", "limitations IS NULL"), ("hold:unverified", "NOT verified"))
#: deadline, active, published, today: how an old item is taken in later.
BACKFILL = (("open_deadline", "deadline >= today"), ("active_signal", "active"), ("undated", "published IS NULL"), ("within_lookback", "published >= today - INTERVAL '21' DAY"))
#: token: whether a status of eligibility is one of those there are, and how its window is called.
ELIGIBILITY = (("ELIGIBLE", "token IN ('eligible', 'yes', 'open')"), ("NOT_ELIGIBLE", "token IN ('not eligible', 'not_eligible', 'no', 'closed')"), ("UNKNOWN", "token IS NULL OR token IN ('', 'unknown', 'n/a')"))
WINDOW = (("closed", "deadline < today"), ("closing", "deadline <= today + INTERVAL '7' DAY"), ("open", "deadline IS NOT NULL"))
#: route, title_lane, undated, toxic: what the purity scan does with an item of a lane.
LANE_SCAN = (("reject:toxic", "toxic = 1"), ("move:grant", "route = 'news' AND channel LIKE 'grant%'"), ("hold:undated", "route = 'news' AND fetched IS NULL"), ("move:research", "route = 'notice' AND channel = 'training'"), ("hold:short", "n_chars < 100"))
#: families, frontier, human.
PROMOTION = (("human", "human"), ("convergence", "families > 1"), ("frontier", "families = 1 AND frontier"))
#: grounded, refs, novelty.
WOW = (("refused", "NOT grounded"), ("thin", "refs < 2"), ("wow", "novelty >= 0.7"), ("plain", "novelty >= 0.3"))
#: feed, login, robots, items, error: tri-states of evidence.
INGESTABLE = (("BLOCKED:robots", "robots = 'deny'"), ("BLOCKED:login", "login = 'yes'"), ("UNKNOWN:not_probed", "feed IS NULL"), ("BROKEN:error", "error IS NOT NULL"), ("EMPTY:no_items", "feed = 'yes' AND items = 0"), ("READY:feed", "feed = 'yes'"), ("MANUAL:no_feed", "feed = 'no'"))
#: status, error: what kind of failure a fetch met, by status before text.
FAILURE = (
    ("ok", "status BETWEEN 200 AND 299"), ("rate_limited", "status = 429"), ("gone", "status IN (404, 410)"), ("denied", "status IN (401, 403, 451)"), ("server", "status >= 500"), ("client", "status >= 400"),
    ("timeout", "lower(error) LIKE '%timed out%' OR lower(error) LIKE '%timeout%'"), ("tls", "lower(error) LIKE '%certificate%'"), ("dns", "lower(error) LIKE '%enotfound%' OR lower(error) LIKE '%resolve%'"), ("parse", "lower(error) LIKE '%parse%'"),
)
#: since_last, cadence (hours), failures, in_window, running, last_start, admitted: the first reason not to run now.
SCHEDULE = (("cadence", "since_last < cadence"), ("not_admitted", "NOT admitted"), ("outside_window", "NOT in_window"), ("interval", "since_start < 1"), ("already_running", "running"), ("circuit_open", "failures >= 3 AND since_last < 24"))
#: hours since the last success against the cadence, for two kinds of source.
FRESHNESS = (("NEVER_RUN", "since_last IS NULL"), ("VERY_STALE", "since_last > 3 * cadence"), ("STALE", "since_last > 1.5 * cadence"))
ALERTS = (("error:circuit", "failures >= 3"), ("error:very_stale", "since_last > 3 * cadence"), ("warning:stale", "since_last > 1.5 * cadence AND since_last <= 3 * cadence"), ("warning:backlog", "backlog > 10"), ("info:due", "since_last >= cadence"))
#: permanent, failures, since_last.
CIRCUIT = (("OPEN", "permanent AND since_last < 72"), ("HALF_OPEN", "permanent"), ("OPEN", "failures >= 3 AND since_last < 24"), ("HALF_OPEN", "failures >= 3"))
#: Outside addresses only: parts of an IPv4 address as numbers, and the host as text.
HOSTS = (
    ("credentials", "url LIKE '%@%'"), ("local_name", "host = 'localhost' OR host LIKE '%.local' OR host LIKE '%.internal'"), ("ipv6", "host LIKE '[%'"), ("decimal", "translate(host, '0123456789', '') = '' AND host <> ''"), ("private", "a = 10 OR a = 127 OR a = 0 OR a = 169 AND b = 254 OR a = 192 AND b = 168 OR a = 172 AND b BETWEEN 16 AND 31 OR a >= 224"), ("secret_value", "url LIKE '%token=%' OR url LIKE '%api_key=%' OR url LIKE '%password=%'"),
)
#: score, kind: tier of a signal.
SIGNAL_TIER = (("tier_1", "score >= 80 AND kind <> 'error'"), ("tier_2", "score >= 50"), ("tier_3", "score >= 20"))
