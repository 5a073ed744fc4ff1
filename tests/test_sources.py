"""Decoders, pushes, streams and rule tables on small inputs written by hand."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import rules, wording
from newsloom.operators import scope
from newsloom.sources import cubes, listings, records


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first()["x"]


def test_cards_and_rows(spark):
    page = "<article><h2>First  card</h2><a href='/a'>x</a>2024-03-04</article><article>no heading<a href='/b'>y</a></article><article><h3>Again</h3><a href='/a'>z</a></article><li>01.02.2024 <a href='/l'>A row</a></li><li><a href='/m'>undated</a></li>"
    df = spark.createDataFrame([(1, "https://x.org", page), (2, "https://x.org", None), (3, "https://x.org", "")], "k int, url string, html string")
    assert [tuple(r) for r in listings.cards(df, "k").collect()] == [(1, 0, "/a", "First card", "2024-03-04")]
    assert [tuple(r) for r in listings.dated_rows(df, "k").collect()] == [(1, 0, "01.02.2024", "/l", "A row")]
    assert {(r["k"], r["strategy"]) for r in listings.cascade(df, "k").collect()} == {(1, "cards")}


def test_prime_jump_goes_around(spark):
    pool = spark.createDataFrame([("s", i) for i in range(10)], "source string, key int")
    assert {r["key"] for r in listings.prime_jump(pool, "key", run=1, size=3).collect()} == {9, 0, 1}
    assert listings.prime_jump(pool, "key", run=4, size=100).count() == 10


def test_citations_enrich(spark):
    answer = spark.createDataFrame([('{"data":[{"pmid":7,"citation_count":3,"nih_percentile":40.5},{"pmid":7,"citation_count":3,"nih_percentile":40.5}]}',)], "json string")
    found = spark.createDataFrame([("7", "a"), ("8", "b"), (None, "c")], "pmid string, title string")
    got = {r["title"]: (r["citations"], r["percentile"]) for r in records.enrich(found, records.icite(answer)).collect()}
    assert got == {"a": (3, 40.5), "b": (None, None), "c": (None, None)}


def test_open_access_list(spark):
    xml = '<records><record id="PMC1" citation="A Journal. 2024 Jan 1" updated="2024-01-02 03:04"><link href="x"/></record></records>'
    r = records.pmc_open(spark.createDataFrame([(xml,), (None,)], "xml string")).collect()
    assert [(x["external_id"], x["container"], str(x["published"])) for x in r] == [("PMC1", "A Journal", "2024-01-02")]


def test_journal_window_takes_its_own_journal(spark):
    rows = spark.createDataFrame([("The Journal, A", "2024-01-05"), ("The Journal A: Supplement", "2024-01-05"), ("the journal a", "2023-01-05"), (None, "2024-01-05")], "container string, d string").withColumn("published", F.to_date("d"))
    assert [r["container"] for r in records.journal_works(rows, "The Journal A", "2024-01-01", "2024-02-01").collect()] == ["The Journal, A"]


def test_least_recent_api(spark):
    apis = spark.createDataFrame([("b", "2024-01-02"), ("a", "2024-01-01"), ("c", None)], "source string, last_run string")
    assert records.least_recent(apis).first()["source"] == "c" and records.least_recent(apis.where("last_run is not null")).first()["source"] == "a"


def test_push_refuses_with_reason(spark):
    rows = ['{"key":"a","title":"one two"}', '{"key":"a","title":"one two","published":"2024-01-02T00:00:00Z"}', "not json", '{"key":"b","title":" "}', '{"key":"c","title":"three","published":"soon"}', None]
    good, bad = records.pushed(spark.createDataFrame([(r,) for r in rows], "json string"))
    assert [r["key"] for r in good.collect()] == ["a"]
    assert sorted((r["reason"], r["raw"]) for r in bad.collect() if r["raw"]) == sorted([("no_key", "not json"), ("no_title", rows[3]), ("bad_day", rows[4])])


def test_connector_run(spark):
    planned = spark.createDataFrame([(i, f" t{i} ") for i in range(6)], "position int, title string")
    got = records.connector_run(planned, lambda df: df.withColumn("title", F.trim("title")), 4, "title <> 't1'").collect()
    assert [r["title"] for r in got] == ["t0", "t2", "t3"]


def test_cubes_are_checked(spark):
    cube = lambda size, value: spark.createDataFrame([(size, [["a", "b"], ["x"]], value)], "size array<int>, categories array<array<string>>, value map<long,double>")
    assert cubes.checked(cube([2, 1], {0: 1.0})).count() == 1
    for wrong, why in ((cube([3, 1], {0: 1.0}), "sizes"), (cube([2, 1], {5: 1.0}), "position")):
        with pytest.raises(cubes.CubeRefused, match=why):
            cubes.checked(wrong)
    with pytest.raises(cubes.CubeRefused, match="cells"):
        cubes.checked(cube([2, 1], {0: 1.0}), most=1)
    assert {(r["coordinate"], r["value"], r["state"]) for r in cubes.slice_of(cube([2, 1], {1: 4.0}), {1: "x"}).collect()} == {("a", None, "missing"), ("b", 4.0, "measured")}
    with pytest.raises(cubes.CubeRefused):
        cubes.slice_of(cube([2, 1], {}), {})


def test_limits_are_validated():
    assert [scope.limit_of(n) for n in (None, 0, -3, 7, 10_000)] == [200, 1, 1, 7, 500]
    assert scope.checked_limit(500) == 500
    for wrong in (0, 501, "5", 2.0, True, None):
        with pytest.raises(ValueError):
            scope.checked_limit(wrong)


def test_rule_tables_by_name(spark):
    rules.register_rule("size", (("small", "n < 3"), ("large", "n > 10")), "middle")
    df = spark.createDataFrame([(1,), (5,), (50,), (None,)], "n int")
    assert [r["x"] for r in df.select(rules.registered("size").alias("x")).collect()] == ["small", "middle", "large", "middle"]


def test_absent_filters_add_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, k string")
    assert scope.where_given(df, k=None).count() == 2 and scope.where_given(df, k="a", i=1).count() == 1
    assert scope.where_given(df, k=None)._jdf.queryExecution().logical().toString() == df._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize(
    "text, found",
    [("Bu bir deneme ve sonuç", "tr"), ("This is the end of the line", "en"), ("lorem ipsum", None), ("Şimdi", "tr"), ("", None)],
)
def test_language_by_letters_and_words(spark, text, found):
    assert one(spark, wording.language(F.col("t")), t=text) == found


def test_takeaway(spark):
    assert one(spark, wording.takeaway(F.col("t")), t="We tried it. It was found to work. More follows.") == "It was found to work."
    assert one(spark, wording.takeaway(F.col("t")), t="One. Two.") == "Two."


def test_search_terms(spark):
    assert one(spark, wording.search_terms(F.col("t"), 2), t="The Sleep quality of sleep in Nurses") == "sleep AND quality"


def test_turkish_days(spark):
    got = one(spark, wording.printed_days(F.col("t")), t="Son gün 5 Ağustos 2024, duyuru 1.2.2024 ve 31.02.2024; 7 Eylül 2023")
    assert [str(d) for d in got] == ["2024-02-01", "2024-08-05", "2023-09-07"]


def test_duplicates_within_a_stream(spark, tmp_path):
    """A replayed key is dropped, in the same batch and in a later one; a batch's keys alone are computed again."""
    from newsloom.streaming.signals import deduplicated, touched

    source = tmp_path / "in"
    rows = spark.sql("select cast('2024-01-01 00:00:00' as timestamp) as at, id % 3 as key from range(7)")
    rows.coalesce(1).write.parquet(str(source))
    rows.coalesce(1).write.mode("append").parquet(str(source))
    stream = deduplicated(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source)), "key", "at")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    history = spark.range(10).select((F.col("id") % 4).alias("key"), "id")
    assert sorted(r["id"] for r in touched(rows.where("key = 1"), history, ["key"]).collect()) == [1, 5, 9]


def test_table_functions(spark):
    from newsloom.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([(1, "<h2>A &amp; b</h2><a href='/x'><b>one</b></a><a href='/y'>two</a>"), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    assert [tuple(r) for r in spark.sql("SELECT id, l.* FROM some_pages, LATERAL page_links(html) l ORDER BY place").collect()] == [(1, 0, "/x", "one"), (1, 1, "/y", "two")]
    assert [tuple(r) for r in spark.sql("SELECT id, h.* FROM some_pages, LATERAL page_headings(html) h").collect()] == [(1, 0, 2, "A & b")]
