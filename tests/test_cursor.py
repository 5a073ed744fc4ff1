"""The paged source: each record once over several runs, rejected tokens, restarts."""

import json

import pytest

from newsloom.sources import cursor as C


def write(folder, days, cut, names="p"):
    """Pages of ``cut`` records in the order of their days; tokens count from 1."""
    pages = [days[i : i + cut] for i in range(0, len(days), cut)] or [[]]
    for old in folder.glob("*.json"):
        old.unlink()
    for n, page in enumerate(pages):
        body = {"records": [{"id": i, "day": d, "body": {"n": i}} for i, d in page], "next": f"{names}{n + 1}" if n + 1 < len(pages) else None}
        (folder / (f"{names}{n}.json" if n else "first.json")).write_text(json.dumps(body))


@pytest.fixture
def folders(tmp_path):
    for name in ("pages", "out", "state"):
        (tmp_path / name).mkdir()
    return tmp_path


def run(spark, f, **options):
    stream = C.cursor_stream(spark, f"file://{f}/pages", **{"as_of": "2024-01-10", "lookback": "5", **options})
    C.advance(stream, f"{f}/out/rows", f"{f}/state/s")
    return spark.read.schema(C.SCHEMA).parquet(f"{f}/out/rows")


DAYS = [(i, f"2024-01-{1 + i // 4:02d}") for i in range(48)]  # four a day, days 1 to 12


@pytest.mark.parametrize("pages", ["1", "3", "50"])
def test_each_record_once(spark, folders, pages):
    """Two runs: the second brings later days and one more record of the newest day; a third brings nothing."""
    write(folders / "pages", DAYS[:30], 7)
    got = run(spark, folders, pages=pages)
    assert sorted(int(r["id"]) for r in C.once(got).collect()) == [i for i, d in DAYS[:30] if d >= "2024-01-05"]
    write(folders / "pages", DAYS, 7)
    got = run(spark, folders, pages=pages)
    wanted = [i for i, d in DAYS if d >= "2024-01-05"]
    assert sorted(int(r["id"]) for r in C.once(got).collect()) == wanted
    n = got.count()
    # the bound's own day is all that comes twice
    assert n - len(wanted) == sum(d == DAYS[29][1] for _, d in DAYS[:30])
    assert run(spark, folders, pages=pages).count() == n
    assert all(json.loads(r["body"]) == {"n": int(r["id"])} for r in got.collect())


def test_rejected_token(spark, folders):
    """A token that is gone: the chain begins again at the newest date seen, and no more than that day is read again."""
    write(folders / "pages", DAYS, 5)
    source = C.PageStream(C.FolderPages(f"file://{folders}/pages"), "2024-01-03", 2)
    first, at = source.read(source.initialOffset())
    got = [int(r[0]) for r in first]
    newest = at["newest"]
    assert at["token"] == "p3" and at["since"] == "2024-01-03" and newest == "2024-01-04"
    write(folders / "pages", DAYS, 5, names="q")  # the old tokens are unknown now
    replayed = []
    while True:
        rows, new = source.read(at)
        rows = [int(r[0]) for r in rows]
        if new == at:
            assert not rows
            break
        replayed += [i for i in rows if i in got]
        got += rows
        at = new
    assert sorted(set(got)) == [i for i, d in DAYS if d >= "2024-01-03"]
    assert all(DAYS[i][1] in (newest, DAYS[-1][1]) for i in replayed) and replayed and at["since"] == DAYS[-1][1]


def test_reads_between_offsets_repeat(folders):
    write(folders / "pages", DAYS, 5)
    source = C.PageStream(C.FolderPages(f"file://{folders}/pages"), "2024-01-02", 3)
    at = source.initialOffset()
    for _ in range(3):
        rows, new = source.read(at)
        assert list(source.readBetweenOffsets(at, new)) == list(rows)
        at = new


def test_no_pages(spark, folders):
    assert run(spark, folders).count() == 0


def test_next_cursors(spark):
    rows = [("on", "COMPLETED", 1, 1, "2024-01-01", "t1", "2024-01-03", None), ("off", "COMPLETED", 1, 1, "2024-01-01", "t1", "2024-01-03", None), ("off", "FAILED", 2, 2, None, None, None, "request failed: 400"), ("other", "COMPLETED", 1, 1, "2024-01-01", "t1", None, None), ("other", "FAILED", 2, 2, None, None, None, "request failed: 4001"),
            ("end", "COMPLETED", 1, 1, "2024-01-01", "t0", None, None), ("end", "COMPLETED", 2, 2, "2024-01-01", None, "2024-01-04", None), ("bare", "COMPLETED", 2, 2, "2024-01-02", None, None, None), ("new", "RUNNING", 1, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "reader string, status string, created_at int, finished_at int, since string, token_out string, newest string, error string")
    df = df.withColumns({c: df[c].cast("date") for c in ("since", "newest")})
    got = {r["reader"]: (str(r["since"]), r["page_token"], r["newest"] and str(r["newest"])) for r in C.next_cursors(df, "2024-02-10").collect()}
    assert got == {"on": ("2024-01-01", "t1", "2024-01-03"), "off": ("2024-01-03", None, None), "other": ("2024-01-01", "t1", None), "end": ("2024-01-04", None, None), "bare": ("2024-01-02", None, None), "new": ("2024-02-07", None, None)}
