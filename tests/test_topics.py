"""Topic tags against a plain statement over random words; the Unicode fold against Python's."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from newsloom.functions.unicode import nfkd_fold
from newsloom.operators.topics import Topic, Unit, tagged


def test_fold_of_every_letter(spark):
    """Every character of the Basic Multilingual Plane and the next, and texts that mix them."""
    texts = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000] + ["Été ﬁn… ½ 한국어 ﷺ Å é̂ x", "", "plain", "ﬁ" * 500 + "é" * 500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    got = {r["i"]: r["f"] for r in rows.select("i", nfkd_fold(F.col("t")).alias("f")).collect()}
    assert got.pop(-1) is None
    assert got == {i: "".join(x for x in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(x) < 0x370) for i, t in enumerate(texts)}


def by_hand(title, abstract, plan):
    """Tags of one text over words that are their own stems."""
    words = [w for w in f"{title or ''} . {abstract or ''}".lower().replace(".", " ").split() if w != "the"]
    out = []
    for t in plan:
        free = list(words)
        for phrase in t.other_senses:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    free[i : i + len(p)] = [""] * len(p)

        def there(stems, free=free):
            lists = [[i for i, w in enumerate(free) if w == s] for s in stems]
            if not stems or not all(lists):
                return False
            width = len(stems) + 2
            for start in lists[0]:
                best = [min(own, key=lambda p: (abs(p - start), p)) for own in lists]
                if all(abs(p - start) < width for p in best) and max(best) - min(best) < width:
                    return True
            return len(stems) == 1

        anchors = [a for a in t.anchors if there(a.split())]
        if not anchors:
            continue
        alone = {a for a in t.anchors if len(a.split()) == 1}
        found = False
        for u in t.units:
            hits = []
            for raw in u.terms:
                own = [w for w in raw.lstrip("~").split() if w != "the"]
                rest = [w for w in own if w not in alone]
                if there(own) or not raw.startswith("~") and 2 <= len(rest) < len(own) and there(rest):
                    hits.append(raw)
            if hits:
                found = True
                out.append((t.topic_id, u.unit_id, u.kind, u.cluster, u.tier, tuple(anchors + hits)))
        if not found:
            out.append((t.topic_id, f"{t.topic_id}-?", "unassigned", None, None, tuple(anchors)))
    on = "title_abstract" if (abstract or "").strip() and (abstract or "").strip() != (title or "").strip() else "title"
    return [(*row, on, "v") for row in out]


PLAN = (
    Topic("A", ("qa", "qb qc"), (Unit("A-1", ("qd qe", "qa qd qe qf"), cluster="c", tier="x"), Unit("A-2", ("qf qf", "~qg")), Unit("A-3", ("qb the qd qb",), "relation")), ("qa qb", "qc qc qa", "qb qd qb")),
    Topic("B", ("qg qa qb",), (Unit("B-1", ("qc",)),), ("qg",)),
    Topic("C", ("qb", "qc"), (), ("qb qb",)),
)


def test_tags_brute_force(spark):
    rng = np.random.default_rng(8)
    words = ["qa", "qb", "qc", "qd", "qe", "qf", "qg", "qh", "qi", "the"]
    texts = []
    for i in range(600):
        title = " ".join(rng.choice(words, rng.integers(0, 12)))
        abstract = None if i % 5 == 0 else title if i % 7 == 0 else " " if i % 11 == 0 else " ".join(rng.choice(words, rng.integers(0, 40)))
        texts.append((i, None if i % 13 == 0 else title, abstract))
    items = spark.createDataFrame(texts, "item_id long, title string, abstract string").withColumns({"stem": F.lit("x"), "at": F.lit(1), "w": F.lit(None)})
    got = sorted((r["item_id"], *(tuple(v) if isinstance(v, list) else v for v in list(r)[1:])) for r in tagged(items, PLAN, "v").collect())
    assert got == sorted((i, *row) for i, t, a in texts for row in by_hand(t, a, PLAN))
    assert len({r[2] for r in got}) == 5  # every unit of the first topic, and topics without one; the second is always another sense
    assert tagged(items.limit(0), PLAN, "v").count() == 0


def test_tags_of_language(spark):
    """Stems, accents, possessives, other senses, a long text."""
    plan = [Topic("S", ("sleep", "nap"), (Unit("S-1", ("sleep pressure", "high-intensity interval training sleep"), cluster="c1", tier="A"), Unit("S-2", ("~alzheimer",))), ("sleeping cell",))]
    rows = [(1, "Quality of Sleep and Alzheimer's", None), (2, "Sleeping cells in cancer", "x"), (3, "Nappíng: high intensity work of interval training", "and sleep pressures"), (4, "nothing", None), (5, "naps", "naps"), (6, "continuous positive airway pressure devices for people with very bad sleep", None), (7, "word " * 300_000 + "sleep", "pressure")]
    items = spark.createDataFrame(rows, "item_id long, title string, abstract string")
    got = {(r["item_id"], r["unit_id"]): r["matched_terms"] for r in tagged(items, plan, "v").collect()}
    assert got == {(1, "S-2"): ["sleep", "~alzheimer"], (3, "S-1"): ["sleep", "nap", "sleep pressure", "high-intensity interval training sleep"], (5, "S-?"): ["nap"], (6, "S-?"): ["sleep"], (7, "S-1"): ["sleep", "sleep pressure"]}


def test_texts_are_matched_where_they_are(spark):
    """No rows of the texts are shuffled or grouped, so a task's memory doesn't grow with their number."""
    plan = tagged(spark.range(5).selectExpr("id AS item_id", "'qa qd qe' AS title", "concat('qb', id) AS abstract"), PLAN, "v")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" not in plan and "Aggregate(keys=[item_id" not in plan and "Sort [item_id" not in plan
