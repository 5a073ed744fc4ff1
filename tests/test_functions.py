"""Functions and operators against plain Python on small fixtures, with nulls, ties and empty tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, rules, text
from newsloom.operators import graph, latest, upsert
from newsloom.sources import cubes, markup


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("printed, day", [("2026-9-7", "2026-09-07"), ("2026 Sep 7", "2026-09-07"), ("2026 Sep", "2026-09-01"), ("2026-09", "2026-09-01"), ("2026", "2026-01-01"), ("7 Sep 2026", "2026-09-07"), ("Mon, 07 Sep 2026 10:00:00 GMT", "2026-09-07"), ("1889", None), ("2026-02-31", None), ("soon", None), (None, None)])
def test_dates(spark, printed, day):
    got = spark.createDataFrame([(printed,)], "c string").select(dates.normalise(F.col("c")).alias("x")).first()["x"]
    assert got == (day and datetime.date.fromisoformat(day))


@pytest.mark.parametrize("word, stem", [("studies", "study"), ("running", "run"), ("tested", "test"), ("matches", "match"), ("cats", "cat"), ("glass", "glass"), ("napping", "nap"), ("virus", "virus"), ("a", "a")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.col("w")), w=word) == stem


def test_fnv(spark):
    h = 2_166_136_261
    for c in "hello":
        h = (h ^ ord(c)) * 16_777_619 % 2**32
    assert one(spark, text.fnv1a(F.col("w")), w="hello") == h


@pytest.mark.parametrize("url, key", [("https://www.A.com/x/?utm_a=1&b=2&a=1#t", "a.com/x?a=1&b=2"), ("http://a.com", "a.com"), ("http://a.com/?utm_a=1", "a.com")])
def test_url_key(spark, url, key):
    assert one(spark, text.url_key(F.col("u")), u=url) == key


def test_identifiers(spark):
    assert one(spark, text.doi(F.col("t")), t="see https://doi.org/10.1000/AB.c).") == "10.1000/ab.c"
    assert one(spark, text.pmid(F.col("t")), t="PMID: 1234567 x") == "1234567"
    assert one(spark, text.doi(F.col("t")), t="none") is None
    assert one(spark, text.redirect_target(F.col("t")), t="https://r.com/?url=https%3A%2F%2Fa.com%2Fb") == "https://a.com/b"
    assert one(spark, text.bigrams(text.tokens(F.col("t"))), t="One two three") == ["one_two", "two_three"]
    assert one(spark, text.bigrams(text.tokens(F.col("t"))), t="one") == []


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (None, "b"), (5, " ")], "a int, b string")
    got = df.select(rules.first_match([("one", F.col("a") == 1), ("big", F.col("a") > 1)], "none").alias("r"), rules.missing(["a", "b"]).alias("m")).collect()
    assert [(r["r"], r["m"]) for r in got] == [("one", ["b"]), ("none", ["a"]), ("big", ["b"])]


def test_latest_keeps_or_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", None, 4)], "k string, t int, v int")
    assert latest.latest_by(df, ["k"], [F.desc("t")], ties="all").count() == 3
    assert {(r["k"], r["v"]) for r in latest.winner(df, ["k"], ["t", "v"], ["v"]).collect()} == {("a", 3), ("b", 4)}
    assert latest.latest_by(df.limit(0), ["k"], [F.desc("t")]).count() == 0


def test_streak_and_budget(spark):
    df = spark.createDataFrame([(1, t, ok) for t, ok in enumerate([1, 0, 0])] + [(2, 0, 1)], "k int, t int, ok int")
    got = {r["k"]: r["streak"] for r in latest.leading_streak(df, ["k"], ["t"], F.col("ok") == 1).collect()}
    assert got == {1: 2, 2: 0}
    assert latest.within_budget(df.withColumn("c", F.lit(2)), [F.col("t")], "c", 4, ["k"]).where("k = 1").count() == 2


def test_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.independence_groups(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for u, v in edges if u != v for n in (u, v)}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "id long, resolved_to long")
    assert {r["id"]: r["survivor"] for r in graph.survivors(chain).collect()} == {1: 4, 2: 4, 3: 4, 7: None, 8: None}
    up = graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "child string, parent string"))
    assert ("a", "c", 2) in {tuple(r) for r in up.select("node", "ancestor", "depth").collect()}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "x", None, "t"), (2, "y", "m", "t")], "k int, v string, m string, f string")
    new = spark.createDataFrame([(1, 1, None, "m1", "u"), (1, 2, "late", None, None), (2, 3, "z", "other", None), (3, 4, "n", None, None)], "k int, n int, v string, m string, f string")
    got = {r["k"]: r for r in upsert.merge(old, new, "k", arrival="n", replaced=["v"], filled=["m"], fixed=["f"]).collect()}
    assert (got[1]["v"], got[1]["m"], got[1]["f"], got[1]["action"]) == ("x", "m1", "t", "meta")
    assert (got[2]["v"], got[2]["m"], got[2]["action"]) == ("z", "m", "full")
    assert got[3]["action"] == "insert"
    assert upsert.insert_absent(old, new.select("k", "v"), ["k"]).count() == 1
    assert [r["k"] for r in upsert.conflicts(new, ["k"], ["v"]).collect()] == [1]


def test_cubes(spark):
    cube = spark.createDataFrame([([2, 3], [["a", "b"], ["x", "y", "z"]], {0: 1.0, 5: 2.0})], "size array<int>, categories array<array<string>>, value map<long,double>")
    got = {tuple(r["coordinates"]): (r["value"], r["state"]) for r in cubes.decode(cube).collect()}
    assert len(got) == 6 and got["a", "x"] == (1.0, "measured") and got["b", "z"] == (2.0, "measured") and got["a", "y"] == (None, "missing")
    keyed = spark.createDataFrame([("1:2", [["a", "b"], ["x", "y", "z"]], 4.0)], "key string, categories array<array<string>>, value double")
    assert cubes.decode_keys(keyed).first()["coordinates"] == ["b", "z"]


def test_markup(spark):
    rss = "<rss><item><title><![CDATA[A <b>x</b>]]></title><link>http://a/1</link><description>d &amp; e</description><pubDate>Mon</pubDate></item><item><title>B</title><guid>http://a/2</guid></item></rss>"
    got = markup.feed_items(spark.createDataFrame([(1, rss), (2, None), (3, "")], "id int, xml string")).orderBy("position").collect()
    assert [(r["title"], r["url"], r["summary"]) for r in got] == [("A x", "http://a/1", "d & e"), ("B", "http://a/2", None)]
    feeds = spark.createDataFrame([("https://a.org/x/feed?p=1", "<item><title>t</title><link>y</link></item>"), ("https://a.org", "<item><title>t</title><link>/y</link></item>"), ("https://a.org/x/", "<entry><title>t</title><link href='//b.org/y'/></entry>"), ("", "<item><title>t</title><link>y</link></item>"), ("https://a.org", "<item><link>y</link></item><item><title>t</title></item>")], "base string, xml string")
    assert sorted(r["url"] for r in markup.feed_items(feeds, base="base").collect()) == ["https://a.org/x/y", "https://a.org/y", "https://b.org/y"]
    for text, out in (("&#65;&#x42;c", "ABc"), ("&#38;lt; &#38;", "&lt; &"), ("&#0; &#xD800; &#99999999; &#; &#12", "&#0; &#xD800; &#99999999; &#; &#12"), ("&#x1F600;", "😀"), ("&#1114112;", "&#1114112;"), ("", ""), (None, None)):
        assert spark.createDataFrame([(text,)], "t string").select(markup.plain(F.col("t"))).first()[0] == out
    site = "<urlset><url><loc>http://a/x</loc><lastmod>2024-01-02T00:00:00Z</lastmod></url></urlset>"
    assert markup.sitemap_urls(spark.createDataFrame([(site,)], "xml string")).first()["last_modified"] == datetime.date(2024, 1, 2)
    page = '<html><head><title>T &amp; U</title><meta property="article:published_time" content="2024-03-04"></head><script>x<y</script><p>Hi <a href="/l">link</a></p></html>'
    row = spark.createDataFrame([(page,)], "html string")
    assert row.select(markup.title(F.col("html"))).first()[0] == "T & U"
    assert row.select(markup.meta_date(F.col("html"))).first()[0] == datetime.date(2024, 3, 4)
    assert row.select(markup.body_text(F.col("html"))).first()[0] == "T & U Hi link"
    assert [(r["href"], r["label"]) for r in markup.links(row).collect()] == [("/l", "link")]


def test_stream_equals_batch(spark, small):
    from newsloom.plans.registry import QUERIES
    from newsloom.sources.tables import load
    from newsloom.streaming.signals import weekly

    batch = {}
    for r in weekly(load(spark, small, "events")).collect():  # one row for each week, family and actor
        key = (str(r["w"]["start"].date()), r["family"])
        batch[key] = batch.get(key, 0) + r["n"]
    assert {(str(r["window_start"]), r["family"]): r["n"] for r in QUERIES["stream_signals"](spark, small).collect()} == batch


@pytest.mark.parametrize("said, day", [("Deadline: 5.3.2026 and due 7/4/2026", "2026-04-07"), ("apply by 3 March", "2026-03-03"), ("closes 1 Jan", "2027-01-01"), ("closes 1 Jan 2030", "2030-01-01"), ("held on 3 March 2026", None), ("due 31.2.2026", None), ("", None),
    ("5 Mart 2026 tarihine kadar başvurun", "2026-03-05"), ("Son başvuru: Eylül 7", "2026-09-07"), ("Deadline is March 15th, 2026", "2026-03-15"), ("Until " + "x" * 38 + " 5.3.2026", "2026-03-05"), ("Until " + "x" * 39 + " 5.3.2026", None), ("5.3.2026 " + "x" * 18 + " until then", "2026-03-05"), ("5.3.2026 " + "x" * 19 + " until then", None), ("deadline 5.3.1999", None)])
def test_deadline(spark, said, day):
    row = spark.createDataFrame([(said, datetime.date(2026, 2, 1))], "t string, p date")
    assert row.select(dates.deadline(F.col("t"), F.col("p"))).first()[0] == (day and datetime.date.fromisoformat(day))


def test_original_study(spark):
    pages = [("<meta property='og:title' content='10.1/x'>", (None, None)), ("<meta name='dc.identifier' content='none'><p>DOI <i>10.5555/Ab.</i></p>", ("10.5555/ab", "https://doi.org/10.5555/ab")), ("", (None, None)), (None, (None, None))]
    for page, found in pages:
        row = spark.createDataFrame([(page,)], "h string").select(text.original_study(F.col("h")).alias("s")).first()["s"]
        assert tuple(row) == found


def test_spread_is_the_greedy_pass(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice("abcd"), rng.choice([None, *range(9)]), i) for i in range(400)]
    families, cap = ("a", "b", "c"), 2
    expected = set()
    for target in range(3):
        units, full = set(), dict.fromkeys(families, 0)
        for _, f, u, i in sorted((r for r in rows if r[0] == target), key=lambda r: r[3]):
            if f in full and full[f] < cap and u not in units:
                units.add(u)
                full[f] += 1
                expected.add((target, f, u, i))
    df = spark.createDataFrame(rows, "target int, family string, unit int, i int")
    got = latest.spread(df.repartition(5), "target", "family", "unit", F.col("i"), families, cap, ["i"])
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    assert latest.spread(df.where("false"), "target", "family", "unit", F.col("i"), families, cap, ["i"]).count() == 0


def test_constraints_on_odd_rows(spark):
    from newsloom.operators import constraints as C

    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "i int, k string")
    assert [(r["k"], r["rows"]) for r in C.repeated(df, ["k"]).collect()] == [(None, 2)]
    assert sorted(r["i"] for r in C.orphans(df, df.where("i <> 2"), ["k"]).collect()) == [1, 2]
    nothing = spark.createDataFrame([], "value_state string, numeric_value double, text_value string, lower_bound double, upper_bound double, interval_type string, status_flag string")
    assert C.violations(nothing, C.VALUE_RULES).count() == 0
    empty = spark.createDataFrame([(None,) * 7, ("PRESENT", float("nan"), None, None, None, None, None)], nothing.schema)
    assert sorted(r["broken"] for r in C.violations(empty, C.VALUE_RULES).collect()) == ["not_finite", "state"]


def test_records(spark):
    from newsloom.sources import records

    rows = lambda j: spark.createDataFrame([(j,), (None,), ("{broken",)], "json string")
    pmc = '{"resultList": {"result": [{"id": "1", "pmid": "11", "doi": "10.1/A", "title": "T  x", "firstPublicationDate": "2024-05-06"}, {"id": "2"}]}}'
    got = records.europe_pmc(rows(pmc)).orderBy("position").collect()
    assert [(r["external_id"], r["doi"], r["title"], r["published"]) for r in got] == [("1", "10.1/a", "T x", datetime.date(2024, 5, 6)), ("2", None, None, None)]
    cross = '{"message": {"items": [{"DOI": "10.2/B", "title": ["U"], "container-title": ["J"], "issued": {"date-parts": [[2023, 4]]}}, {"DOI": "10.2/C"}]}}'
    got = records.crossref(rows(cross)).orderBy("position").collect()
    assert [(r["doi"], r["container"], r["published"]) for r in got] == [("10.2/b", "J", datetime.date(2023, 4, 1)), ("10.2/c", None, None)]
    alex = '{"results": [{"id": "https://openalex.org/W9", "doi": "https://doi.org/10.3/D", "title": "V", "publication_date": "2022-01-02", "primary_location": {"source": {"display_name": "K"}}}]}'
    r = records.openalex(rows(alex)).first()
    assert (r["external_id"], r["doi"], r["container"]) == ("W9", "10.3/d", "K")
    more = records.enrich(records.europe_pmc(rows(pmc)), spark.createDataFrame([("11", 3.5), ("11", 3.5)], "pmid string, ratio double"))
    assert sorted(r["ratio"] or 0 for r in more.collect()) == [0, 3.5]


def test_trial_signals(spark):
    import json

    from newsloom.sources import records

    study = {"protocolSection": {"identificationModule": {"nctId": "N1"}, "statusModule": {"studyFirstPostDateStruct": {"date": "2024-01-02"}}, "conditionsModule": {"conditions": ["Flu", "flu", ""]}, "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "Sugar"}, {"type": "DRUG", "name": "Real"}], "armGroups": [{"type": "PLACEBO_COMPARATOR", "interventionNames": ["Drug: Sugar"]}, {"type": "EXPERIMENTAL", "interventionNames": ["Drug: Real"]}]}}}
    undated = {"protocolSection": {"identificationModule": {"nctId": "N2"}, "conditionsModule": {"conditions": ["x"]}}}
    got = {(r["study_id"], r["family"], r["label"], r["role"]) for r in records.trial_signals(spark.createDataFrame([(json.dumps({"studies": [study, undated]}),)], "json string")).collect()}
    assert got == {("N1", "condition", "Flu", "topic"), ("N1", "intervention", "Sugar", "control"), ("N1", "intervention", "Real", "topic")}


def test_sinks(spark, tmp_path):
    from newsloom.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, c string")
    put = sinks.write_batch(str(tmp_path / "out"))
    put(df, 0), put(df, 0), put(df, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert sinks.with_artifact_id(df, "c").count() == 2
    first = sinks.outbox(df, spark.createDataFrame([], "dedupe_key string"), ["c"])
    assert first.count() == 2 and sinks.outbox(df, first, ["c"]).count() == 0
    assert [r["k"] for r in sinks.changed_snapshots(df, spark.createDataFrame([(1, "a"), (2, "z")], "k int, c string"), "k", "c").orderBy("k").collect()] == [2, 3]


def test_stateful_streaks(spark, tmp_path):
    from newsloom.streaming.streaks import accept_streaks

    source, out = tmp_path / "in", tmp_path / "out"
    runs = [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("b", 1, 4), ("b", 2, 0)]
    spark.createDataFrame(runs, "source string, run long, accepted long").coalesce(1).write.parquet(str(source))

    def go():
        stream = accept_streaks(spark.readStream.schema("source string, run long, accepted long").parquet(str(source)))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    go()
    spark.createDataFrame([("a", 3, 9), ("a", 4, 1), ("b", 3, 0)], "source string, run long, accepted long").coalesce(1).write.mode("append").parquet(str(source))
    go()
    got = {(r["source"], r["run"]): (r["streak"], r["state"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {("a", 1): (1, "warning"), ("a", 2): (2, "warning"), ("a", 3): (3, "low"), ("b", 1): (0, "configured"), ("b", 2): (1, "warning"), ("a", 4): (0, "configured"), ("b", 3): (2, "warning")}


def test_listings(spark):
    from newsloom.sources import listings

    page = """<a href="/">Home</a><h2>A heading of an item</h2><p>x</p><a href="/a">Read more</a><a href="https://www.x.org/b/2024-03/">Another item here</a>
    <a href="https://other.org/c">Something elsewhere</a><a href="/a#top">Again the same target</a><a href="/d">short</a>"""
    df = spark.createDataFrame([(1, "https://x.org/news", page), (2, "https://x.org/", None)], "id int, url string, html string")
    got = [(r["place"], r["href"], r["title"]) for r in listings.listing_links(df, "id").orderBy("place").collect()]
    assert got == [(1, "https://www.x.org/b/2024-03/", "Another item here"), (2, "/a", "A heading of an item")]
    d = datetime.date
    entries = spark.createDataFrame([("https://x.org/a", d(2024, 3, 1)), ("https://x.org/", d(2024, 3, 1)), ("https://x.org/b", d(2023, 1, 1)), ("https://x.org/c", d(2024, 3, 9)), ("https://x.org/e", None)], "url string, last_modified date")
    assert [r["url"] for r in listings.recent_entries(entries, "2024-03-02", 10).collect()] == ["https://x.org/a"]
    pool = spark.createDataFrame([("s", u) for u in "abcde"], "source string, u string")
    seen = spark.createDataFrame([("s", "b")], "source string, u string")
    assert sorted(r["u"] for r in listings.rotation_window(pool, "u", seen, start=3, size=2).collect()) == ["a", "e"]
    found = spark.createDataFrame([(1, "links", "x"), (1, "feed", "y"), (2, "links", "z")], "id int, strategy string, item string")
    assert sorted(r["item"] for r in listings.best_strategy(found, ["id"], ["feed", "sitemap", "links"]).collect()) == ["y", "z"]


@pytest.mark.parametrize("raw, fine", [("caf\u00c3\u00a9", "caf\u00e9"), ("plain", "plain"), ("\u00c3\u0028", "\u00c3\u0028"), ("中\u00c3\u00a9", "中\u00c3\u00a9")])
def test_repaired(spark, raw, fine):
    assert one(spark, text.repaired(F.col("t")), t=raw) == fine


def test_keyword_gate(spark):
    gate = rules.keyword_gate(F.col("t"), [("event", ["congress"])], [("grant", ["scholarship", "grant"])])
    df = spark.createDataFrame([("a grant for all",), ("congress grant",), ("nothing",), (None,)], "t string")
    assert [r["x"] for r in df.select(gate.alias("x")).collect()] == ["accept:grant", "discard:event", "discard:no_signal", "discard:no_signal"]


def test_repaired_windows_1252(spark):
    for fine in ("don’t – “quoted” €5", "naïve café", "Çağrı"):
        broken = fine.encode("utf-8").decode("cp1252", errors="replace")
        if "\ufffd" not in broken:
            assert one(spark, text.repaired(F.col("t")), t=broken) == fine
    for plain in ("plain", "â alone", "5 € and ’ as they are"):
        assert one(spark, text.repaired(F.col("t")), t=plain) == plain


def test_long_merge_chains(spark):
    """A chain longer than sixteen doublings of small steps would see, and a circle beside it."""
    chain = spark.range(300).select("id", (F.col("id") + 1).alias("resolved_to")).unionAll(spark.createDataFrame([(1000, 1001), (1001, 1002), (1002, 1000)], "id long, resolved_to long"))
    got = {r["id"]: r["survivor"] for r in graph.survivors(chain).collect()}
    assert all(got[i] == 300 for i in range(300)) and got[1000] is got[1001] is got[1002] is None


def test_stream_reads_its_table_alone(spark, tmp_path):
    from newsloom.streaming.signals import weekly_signals

    rows = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as ts, 'view' as event_type, id as user_id from range(3)")
    for name in ("events", "events_old"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [(r["n"], r["actors"]) for r in weekly_signals(spark, f"{tmp_path}/events.parquet").collect()] == [(3, 3)]


def test_cross_links_against_all_pairs(spark, small):
    import difflib

    from newsloom.plans.registry import QUERIES
    from newsloom.sources.tables import items

    first: dict[tuple, int] = {}
    for r in items(spark, small).select("source_id", "title", "item_id").collect():
        if len(r["title"]) >= 24:
            key = (r["source_id"], r["title"])
            first[key] = min(first.get(key, r["item_id"]), r["item_id"])
    rows, expected = sorted((i, *key) for key, i in first.items()), set()
    for n, (i, source, title) in enumerate(rows):
        for j, other_source, other in rows[n + 1 :]:
            if source != other_source and min(len(title), len(other)) >= 0.66 * max(len(title), len(other)):
                match = difflib.SequenceMatcher(None, title, other)
                if match.quick_ratio() >= 0.8 and match.ratio() >= 0.8:
                    expected |= {(i, j), (j, i)}
    assert expected and {(r["item_id"], r["other_id"]) for r in QUERIES["cross_links"](spark, small).collect()} == expected


def test_training_against_plain_steps(spark):
    """The model's folds, by the same gradient steps written out over sets of words."""
    import math

    from newsloom.plans import texts

    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma"]
    rng = random.Random(2)
    docs = [(i, " ".join(rng.sample(words, 3)), rng.randrange(2)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    buckets = {r["doc_id"]: r["b"] for r in texts._features(df.select("doc_id", "text")).groupBy("doc_id").agg(F.collect_list("bucket").alias("b")).collect()}
    got = {r["fold"]: r for r in texts._validated(df.select("doc_id", "text"), df.select("doc_id", "quality"), epochs=7).collect()}
    for fold in range(5):
        w: dict = {}
        score = lambda i, w=w: 1 / (1 + math.exp(-sum(w.get(b, 0.0) for b in [*buckets[i], "bias"])))
        for epoch in range(7):
            for i, _, label in docs:
                if i % 5 != fold:
                    error = score(i) - label
                    for b in [*buckets[i], "bias"]:
                        w[b] = w.get(b, 0.0) - 0.2 / (1 + 0.2 * epoch) * (error + 0.001 * w.get(b, 0.0))
        tested = [(score(i), label) for i, _, label in docs if i % 5 == fold]
        assert got[fold]["n"] == len(tested) == 8
        assert got[fold]["mae"] == pytest.approx(sum(abs(p - label) for p, label in tested) / 8)
        assert got[fold]["accuracy"] == pytest.approx(sum((p >= 0.5) == label for p, label in tested) / 8)


@pytest.mark.parametrize("page, found", [
    ('<meta content="doi:10.1234/meta" name="citation_doi"><p>DOI 10.9/x</p>', "10.1234/meta"), ("<a class='x' href='https://dx.doi.org/10.1000/Link'>y</a>", "10.1000/link"), ("<p>Journal reference: Nature <b>4</b>, DOI: 10.1038/s41586</p><a href='https://doi.org/10.1/2'>z</a>", "10.1038/s41586"),
    ("<p>DOI " + "word " * 60 + "10.5555/far</p>", None), ("<a href='https://example.org/10.5555/no'>z</a>", None),
])
def test_original_study_by_kind(spark, page, found):
    row = spark.createDataFrame([(page,)], "h string").select(text.original_study(F.col("h")).alias("s")).first()["s"]
    assert row["doi"] == found and row["link"] == (found and f"https://doi.org/{found}")


@pytest.mark.parametrize("number, found", [("123", None), ("7051", "7051"), ("989999", "989999"), ("1000000", "1000000"), ("12345678901", "12345678901")])
def test_article_numbers_of_any_length(spark, number, found):
    url = f"https://www.nature.com/articles/S41586-024-{number}-x?a=1"
    got = spark.createDataFrame([(url,)], "u string").select(text.article_doi(F.col("u")).alias("d")).first()["d"]
    assert got == (found and f"10.1038/s41586-024-{found}-x")
