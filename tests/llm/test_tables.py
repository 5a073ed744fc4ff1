"""Token files, pages, conversations, vectors and the pipeline against brute force and round trips."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import ann, chat, divergence, extraction, langid, lexical, mtree, queries, secrets, simhash, terms, tokens


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- token counts


def test_token_counts(spark, medium):
    encode = tokens._encoding(tokens.vocabulary(tokens.RANKS)).encode_ordinary
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_counts(spark, medium).collect()}
    assert got == {r["doc_id"]: len(encode(r["text"])) for r in table(spark, medium, "documents").collect()}


@pytest.mark.parametrize("block", [2, 8, 14, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(0)
    expected = {}
    for name, ends in (("a", True), ("b", False), ("c", True)):
        ids = rng.choice([7, 9, 3], 50, p=[0.2, 0.4, 0.4]).astype("<u2")
        ids = np.append(ids, [7] if ends else [9]).astype("<u2")
        ids.tofile(tmp_path / f"{name}.bin")
        cuts = [-1, *np.flatnonzero(ids == 7).tolist(), *([] if ends else [len(ids)])]
        expected[name] = [(a + 1, b - a - 1) for a, b in zip(cuts[:-1], cuts[1:])]
    (tmp_path / "d.bin").write_bytes(b"")
    got = {}
    for r in tokens.scan(spark, f"file://{tmp_path}", eod=7, block_bytes=block).orderBy("path", "ordinal").collect():
        got.setdefault(re.search(r"(\w)\.bin", r["path"])[1], []).append((r["start"], r["n_tokens"]))
    assert got == expected


def test_token_counts_odd(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> is text"), (3, "again"), (None, "x"), (4, "word " * 200_000)], "doc_id long, text string").withColumn("ordinal", F.lit("clash")).withColumn("file", F.lit(1))
    encode = tokens._encoding(tokens.vocabulary(tokens.RANKS)).encode_ordinary
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.count(docs).collect())
    assert got == sorted((r["doc_id"] or 0, len(encode(r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.lengths(docs).collect()) == got
    assert tokens.count(docs.limit(0)).count() == tokens.lengths(docs.limit(0)).count() == 0


def test_token_files_are_removed(spark, small):
    import os

    folder = tokens.shared_dir(spark).removeprefix("file:")
    assert tokens.count(table(spark, small, "documents")).count() > 0
    assert not [x for x in os.listdir(folder) if x.startswith("tokens-")]


# --- pages


def is_held(page_id):
    return zlib.crc32(str(page_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def weights(spark, medium):
    """Learnt without the held-out pages."""
    return extraction.fit(table(spark, medium, "pages").where("crc32(cast(page_id as string)) % 5 <> 0"))


def article(page):
    """Every block of the test pages lies in an article or in named furniture, so the text is known."""
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)
    parts = re.split(r"</?(?:p|h1|h2|li|ul|article|div|footer)\b[^>]*>", inner[1]) if inner else []
    plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p)))).strip() for p in parts]
    return "\n".join(p for p in plain if p)


def test_extraction_of_held_out_pages(spark, medium, weights):
    pages = [r for r in table(spark, medium, "pages").collect() if is_held(r["page_id"])]
    got = {r["page_id"]: r["text"] for r in extraction.extract(table(spark, medium, "pages"), weights).collect()}
    assert len(pages) > 30 and sum(got[r["page_id"]] == article(r["html"]) for r in pages) >= 0.97 * len(pages)


WORDS = "The quick brown fox jumps over the lazy dog near the river bank today."
LAYOUTS = {
    "<html><head><title>x</title><article><p>text one here.</p></article>": "text one here.",
    "<article><h1>A title</h1><p>Where <math><mi>x</mi></math> and <button>press</button> stand.</p></article>": "A title\nWhere x and press stand.",
    "<article><p>It says &am<b>p;</b> in this line &lt;here&gt;.</p></article>": "It says &amp; in this line <here>.",
    "<main><p>Intro words here.</p><pre>a = 1\n b = 2</pre><details><summary>More</summary><p>Hidden words are here too.</p></details></main>": "Intro words here.\na = 1 b = 2\nMore\nHidden words are here too.",
    f"<table><tr><td><a href=/>Home</a> <a href=/b>News</a></td></tr><tr><td><h1>Head line of it</h1><p>{WORDS}</p><p>{WORDS} Twice.</p></td></tr></table>": f"Head line of it\n{WORDS}\n{WORDS} Twice.",
    "<html><body><div>" + "".join(f"<p>Paragraph {i} of the long text.</p>" for i in range(120)) + "</div></body></html>": "\n".join(f"Paragraph {i} of the long text." for i in range(120)),
    f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div>{f'<p>{WORDS}</p>' * 300}</div><footer>Copyright us</footer></body></html>": "\n".join([WORDS] * 300),
    f"<html><body><div><p>{WORDS}</p></div><div class='comments'><p>I like it.</p><p>Me too, thanks.</p></div></body></html>": WORDS,
}


def test_layouts(spark, weights):
    """Pages without head or body, tables, references cut by tags, unnamed and long layouts."""
    df = spark.createDataFrame([(i, "u", page) for i, page in enumerate(LAYOUTS)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df, weights).collect()}
    for i, text in enumerate(LAYOUTS.values()):
        assert got[i] == text, i


def test_gradients_against_differences():
    """Backpropagation through time, on pages of different length, against finite differences."""
    rng = np.random.default_rng(0)
    model = extraction.Labeller(seed=1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.normal(size=(3, 5, extraction.INPUT)) * (rng.random((3, 5, extraction.INPUT)) < 0.02)
    y, mask = rng.integers(0, 2, (3, 5)).astype(float), np.arange(5)[None, :] < np.array([[5], [3], [1]])
    _, grad = model.gradients(x, y, mask)
    used = np.flatnonzero(np.abs(x).sum((0, 1)))
    for name, w in model.w.items():
        for _ in range(6):
            at = tuple(int(rng.choice(used)) if name.startswith("x") and d == 0 else int(rng.integers(0, n)) for d, n in enumerate(w.shape))
            old, loss = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                loss.append(model.gradients(x, y, mask)[0])
            w[at] = old
            assert np.isclose(grad[name][at], (loss[0] - loss[1]) / 2e-5, rtol=1e-3, atol=1e-8), (name, at)


def test_forward_pass_is_the_trained_one():
    """Scores of pages equal the pass that training differentiates, whatever pages they are batched with."""
    rng, make = np.random.default_rng(2), extraction.Features()
    model = extraction.Labeller(seed=1)
    pages = [extraction.blocks(extraction.invented_page(rng)[0]) for _ in range(6)]
    together = model.scores(pages, make)
    for own, p in zip(pages, together):
        assert np.allclose(p, model.scores([own], make)[0], atol=1e-5)


def test_extraction_odd(spark, weights):
    cases = {
        1: None, 2: "", 3: "<html><body><article><p>One &amp; two&nbsp;&#33;</p><script>no()</script><style>p{}</style><p>Three\n\n four<br>five</p></article></body></html>",
        4: "plain words only", 5: "<p>un<b>closed <p>second <!-- gone --> part <di", 6: "<article>" + "<p>a b c d e.</p>" * 5_000 + "</article>", 7: "<<<>>>&&&", 8: "<article><p>x</p><p>x</p></article>",
    }
    df = spark.createDataFrame([(k, "u", v) for k, v in cases.items()], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in extraction.extract(df, weights).collect()}
    assert got[1] == got[2] == "" and len(got) == len(cases)
    assert got[3] == "One & two !\nThree four five"
    assert got[6].count("\n") == 4_999
    assert extraction.extract(df.limit(0), weights).count() == 0


def test_blocks():
    b = extraction.blocks("<ul><li>a<li>b</ul><p>c <i>d</i>e<div>f &lt;g&gt;</div><title>no</title>1 < 2<script>if (a<b) '</p>'</script>")
    assert [x.text for x in b] == ["a", "b", "c de", "f <g>", "1 < 2"]
    assert b[0].path == ("ul", "li") and b[3].path == ("div",)


def test_quotes_in_tags():
    """A quote opens a value only after an equals sign and if it is closed; nothing else is lost."""
    words = lambda page: [b.text for b in extraction.blocks(page)]
    assert words("<p class=it's>Hello world here.</p><p>We don't stop now.</p><p>Third.</p>") == ["Hello world here.", "We don't stop now.", "Third."]
    assert words('<a href=x title=5">Link five</a><p>next</p>') == ["Link five", "next"]
    assert words('<p title = "a > b">one</p><p title=\'c>"d\'>two</p>') == ["one", "two"]
    assert words('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert words("<p>a <!-- <p>no</p> --> b <!DOCTYPE x> c</p><!-- open <p>no</p>") == ["a b c"]
    assert words("one <b") == ["one"] and words("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"]


@pytest.mark.parametrize("piece", ["<a '", "<a ='", '<a ="x', "<a =\"'>", "<!-- ", "<b ", "<b>", "<div>x", "</i><b>", "<b></i>", "<script>", "<p>it's <q x='>", "&lt "])
def test_long_pages_take_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    extraction.blocks(page)
    assert time.perf_counter() - began < 20


def test_invented_layouts(weights):
    rng = np.random.default_rng(1234)  # another seed than the training layouts'
    model, make = extraction.Labeller(weights), extraction.Features()
    wrong = total = 0
    for _ in range(150):
        page, labels = extraction.invented_page(rng)
        own = extraction.blocks(page)
        assert len(own) == len(labels)
        wrong += int(((model.scores([own], make)[0] >= 0.5) != np.array(labels)).sum())
        total += len(labels)
    assert wrong / total < 0.03


# --- conversations


def test_chat_equals_sql(spark, duck, medium):
    got = queries.op8_chat(spark, medium).toPandas().sort_values("conv_id").reset_index(drop=True)
    expected = duck.execute(queries.SQL["op8_chat"]).df().sort_values("conv_id").reset_index(drop=True)
    for c in expected.columns:
        assert (got[c].to_numpy() == expected[c].to_numpy()).all(), c


def test_chat_is_native(spark, small):
    plan = queries.op8_chat(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fold(spark):
    log = [
        ("c", "m1", 1, "delta", 0, "user", "Hel"), ("c", "m1", 2, None, 0, "user", "lo"), ("c", "m2", 3, "delta", 1, "assistant", "old"), ("c", "m3", 4, "delta", 2, "user", "gone"),
        ("c", "m2", 5, "regenerate", 1, "assistant", "ne"), ("c", "m2", 6, "delta", 1, "assistant", "w"), ("c", "m4", 7, "delta", 2, "user", "x"), ("c", "m4", 8, "edit", 2, "user", "y"), ("d", "m1", 1, "delta", 0, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id string, message string, seq int, event string, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold(events).collect()}
    assert got == {("c", 0, "user", "Hello"), ("c", 1, "assistant", "new"), ("c", 2, "user", "y"), ("d", 0, "", "")}
    assert chat.digests(chat.read_back(chat.render(chat.fold(events.limit(0))))).count() == 0


def test_log_of_turns_folds_to_them(spark, small):
    """Drafts, edits, regenerations, withdrawn follow-ups and deltas come before every turn, and leave only it."""
    rows = [(1, 0, "user", "a question?"), (1, 1, "assistant", "an answer"), (1, 1, "assistant", "an answer"), (1, 2, "user", ""), (1, 3, "assistant", None), (None, 0, "user", "no conversation"), (None, 1, "assistant", "x"), (2, None, "assistant", "no turn"), (2, None, None, "no role"), (2, 5, "assistant", "é" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    log = chat.events_of(turns)
    kinds = {r["event"]: r["count"] for r in log.groupBy("event").count().collect()}
    assert kinds["regenerate"] == 6 and kinds["edit"] == 4 and log.groupBy("message").count().where("count > 3").count() == len(rows)
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold(log.orderBy("text")).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted([(c, t, r or "", x or "") for c, t, r, x in rows], key=key)
    read = {r["conv_id"]: len(r["turns"]) for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    assert read == {1: 5, None: 2, 2: 3}


NASTY = ["", "\\", "<|", "<|end|>", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "a\\<|b\\\\", "<", "|>", "<<|end|>", "\n\n", "é\U0001f600", "<s><<SYS>>\\[INST]", "<|learn|>", "$1 \\1"]


def round_trip(spark, convs):
    rows = [(i, t, r, x) for i, turns in enumerate(convs) for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    written = chat.render(chat.fold(chat.events_of(df))).cache()
    for r in chat.read_back(written).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == convs[r["conv_id"]]
        assert all(t["learnt"] == (t["role"] == "assistant") for t in r["turns"])
    unescape = lambda s: re.sub(r"(?s)\\(.)", r"\1", s)
    for r in written.collect():
        spans = [unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"]]
        assert spans == [x for role, x in convs[r["conv_id"]] if role == "assistant"]
    for r in chat.digests(chat.read_back(written)).collect():
        turns = convs[r["conv_id"]]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    written.unpersist()


def test_chat_round_trip(spark):
    round_trip(spark, [[("user", a), ("assistant", b)] for a in NASTY for b in NASTY] + [[(a, a)] for a in NASTY] + [[("user", "x")] * 3])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|x"]), st.text(st.sampled_from("<|\\>/s[]INST end\n"), max_size=30)), min_size=1, max_size=4), min_size=1, max_size=6))
def test_chat_round_trip_property(spark, convs):
    round_trip(spark, [list(c) for c in convs])


# --- vectors


def nearest(ids, x, i, k):
    s = (x * x[i]).sum(1)
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def test_neighbours(spark, medium):
    rows = table(spark, medium, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in queries.op10_neighbours(spark, medium).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and all(len(v) == 20 for v in got.values())
    hit = 0
    for q, found in got.items():
        i = int(np.flatnonzero(ids == q)[0])
        hit += len({v for v, _ in found} & {v for v, _ in nearest(ids, x, i, 20)})
        for v, s in found:
            assert s == (x[i] * x[np.flatnonzero(ids == v)[0]]).sum()
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit >= 0.9 * 20 * len(got)


def test_neighbours_odd(spark):
    """Ties, repeated rows, vectors that take no part, and fewer rows than asked for: exact."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]), (8, [-1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (10, [1.0, 2.0, 3.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("probe", F.lit(1)).withColumn("key", F.lit("x"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(2, 2.0), (1, 1.0), (9, 1.0), (20, 0.5), (8, -1.0)], 20: [(2, 1.5), (0, 0.5), (1, 0.5), (9, 0.5), (8, -0.5)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_neighbours_with_many_copies(spark):
    """A vector that a third of the rows share: ties go to the smallest ids, over chunks too."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in ann.search(df, F.col("vec_id") == 300, settings=ann.Settings(chunk_rows=100, target=1.0)).orderBy("rank").collect()]
    assert got == [v for v, _ in nearest(np.arange(900), x.astype(float), 300, 20)]


def searched(df, how):
    """Result and hash functions of a search."""
    hashing = []
    real = ann.fit
    ann.fit = lambda *a: hashing.append(real(*a)) or hashing[-1]
    try:
        return ann.search(df, F.col("vec_id") % 20 == 0, settings=how).toPandas(), hashing[0]
    finally:
        ann.fit = real


def test_neighbours_visit_little(spark, medium):
    """Queries find enough in part of the table, a part that falls with its size; ``visited`` counts all rows of the buckets that are named."""
    rows = table(spark, medium.replace("sf0.01", "sf0.1"), "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    rng = np.random.default_rng(0)
    more = rng.normal(size=(12_000, 64))
    more /= np.linalg.norm(more, axis=1)[:, None]
    shares = []
    for some, how in ((x, ann.Settings()), (x, ann.Settings(cell_rows=500, chunk_rows=100)), (more, ann.Settings())):
        n = len(some)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)], "vec_id long, embedding array<double>")
        got, hashing = searched(df, how)
        hit = sum(len(set(g["vec_id"]) & {v for v, _ in nearest(np.arange(n), some, int(q), 20)}) for q, g in got.groupby("query_id"))
        assert hit >= 0.9 * 20 * got["query_id"].nunique() and got["query_id"].nunique() == n // 20
        shares.append(got.drop_duplicates("query_id")["visited"].mean() / n)
        buckets = hashing.buckets(some)
        for q in (0, 20, 400):
            asked = hashing.probed(some[q : q + 1])[0]
            assert len(asked) == hashing.tables and all(0 < len(set(a.tolist())) == len(a) <= how.most_probes for a in asked)
            assert got[got["query_id"] == q]["visited"].iloc[0] == sum(np.isin(buckets[:, t], a).sum() for t, a in enumerate(asked))
    assert shares[0] < 0.65 and abs(shares[1] - shares[0]) < 0.02 and shares[2] < 0.45


@pytest.mark.parametrize("functions", [1, 2, 4])
def test_probe_sequence_brute_force(functions):
    """The first buckets of the sequence are those of most success among all."""
    from itertools import product

    rng = np.random.default_rng(functions)
    success = rng.normal(size=(4, functions, ann.CELLS))
    own = ann.Hashing(ann.Settings(), 6, 1.0, 1, functions)
    names, total = own.sequence(success, 9)
    for i in range(4):
        every = sorted(((-sum(success[i, j, c] for j, c in enumerate(cells)), sum(c * ann.CELLS**j for j, c in enumerate(cells))) for cells in product(range(ann.CELLS), repeat=functions)))[:9]
        assert names[i].tolist() == [n for _, n in every] and np.allclose(total[i], [-c for c, _ in every])


def test_success_is_a_chance():
    """Over a function's cells, chances add up to one, and follow where neighbours fall."""
    rng = np.random.default_rng(2)
    q = rng.normal(size=(200, 16))
    near = [(0.6 * v / np.linalg.norm(v) + rng.normal(size=(20, 16)) * 0.2) for v in q]
    near = [v / np.linalg.norm(v, axis=1)[:, None] for v in near]
    sample = rng.normal(size=(2000, 16))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    h = ann._fitted(ann.Hashing(ann.Settings(), 16, 1.0, middle=np.zeros(0), width=np.zeros(0)), q, near, sample, 2000)
    chance = np.exp(h.success(q))
    assert np.allclose(chance.sum(3), 1, atol=1e-6)
    cells = np.stack([h.cells(h.projected(v, False)) for v in near])
    for c in (1, 2):
        assert abs((cells == c).mean() - chance[..., c].mean()) < 0.03


def test_neighbours_with_repeated_rows(spark):
    """Rows stored several times, one of them often, and ids with two vectors: twenty different ids, the exact ones."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    second = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(60) for _ in range(3)] + [(7, x[7].tolist())] * 30 + [(i, second[i].tolist()) for i in range(30, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    score = np.maximum(x.astype(float) @ x[:30].T.astype(float), np.where(np.arange(60)[:, None] >= 30, second.astype(float) @ x[:30].T.astype(float), -np.inf))
    for how in (ann.Settings(), ann.Settings(most_tables=1, width=0.05), ann.Settings(target=1.0), ann.Settings(chunk_rows=50, cell_rows=10)):
        got = {}
        for r in ann.search(df, F.col("vec_id") < 30, settings=how).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert set(got) == set(range(30)) and all(len(set(v)) == len(v) == 20 for v in got.values())
        if how.target == 1.0:  # the sample holds all queries, so the buckets of all their neighbours are visited
            assert got == {q: [i for i in np.argsort(-score[:, q], kind="stable").tolist() if i != q][:20] for q in range(30)}


# --- pipeline


def test_pipeline_by_hand(spark, medium):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in table(spark, medium, "documents").collect()}
    words = lambda t: re.findall(r"\w+", t.lower())
    profiles = langid.fit(table(spark, medium, "documents").where("crc32(cast(doc_id as string)) % 5 <> 0").select("text", "lang"))
    left = {i: t for i, t in docs.items() if langid.label([t], profiles)[3][0] >= 3.5 / langid.DIM**0.5}
    fps = np.array([simhash.fingerprint(t) for t in left.values()], np.uint64)
    ids = np.array(list(left))
    root = ids.copy()
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)
        low = root[near].min()
        for old in set(root[near]):
            root[root == old] = low
    left = {i: left[i] for i, r in zip(ids.tolist(), root.tolist()) if i == r}
    items = [" ".join(words(r["text"])) for r in table(spark, medium, "benchmark").collect()]
    left = {i: t for i, t in left.items() if not any(f" {x} " in f" {' '.join(words(t))} " for x in items)}
    encode = tokens._encoding(tokens.vocabulary(tokens.RANKS)).encode_ordinary
    passed = secrets.limit(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
    expected = {i: len(encode(secrets.redact_text(t, passed))) for i, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, medium).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == expected


ODD = [(1, None), (None, None), (2, ""), (3, "the cat and the dog were there"), (None, "the cat and the dog were there"), (4, "the cat and the dog were there"), (5, "12 34 !"), (6, "the word and the other " * 40_000),
       (7, "one two three four five six seven eight nine ten eleven the twelve"), (None, "that one two three four five six seven eight nine ten eleven the twelve"), (8, "the key token = abcdefghijklmnop is there"), (8, "and there was another text of the same id"), (9, "Съешь ещё этих мягких французских булок да выпей чаю, а потом иди домой через большой лес")]


def test_pipeline_odd(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, copies, another script and clashing columns, through all stages; and an empty table."""
    import corpus_pipeline

    taught = [(100 + i, t, "en") for i, t in enumerate(["the cat and the dog were there and the other one too", "there was another word of the key and that is there", "one of the ten was there and two were not"])]
    rows = [(i, t, None) for i, t in ODD] + taught
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit(1).alias(c) for c in ("id", "fp", "words", "shard", "row", "__text", "n_tokens")), F.lit(7).cast("long").alias("n_chars"))
    for name, own in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        own.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven the twelve")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, at, folder)
            assert out.schema.names == at.schema.names, stage
            out.coalesce(1).write.parquet(f"{folder}/{stage.replace(' ', '-')}")
            at = spark.read.parquet(f"{folder}/{stage.replace(' ', '-')}")
        left = [(r["doc_id"], r["text"], r["n_chars"]) for r in at.collect()]
        if name == "none":
            assert not left and corpus_pipeline.run(spark, folder).count() == 0
            continue
        assert {i for i, _, _ in left} == {3, 6, 8, 100, 101, 102} and len(left) == 7
        assert (8, "the key [assign removed] is there", 33) in left and (8, "and there was another text of the same id", 41) in left
        assert sum(r["length"] for r in corpus_pipeline.run(spark, folder).collect()) > 40_000
    import os

    shared = tokens.shared_dir(spark).removeprefix("file:")
    assert all(len(os.listdir(f"{shared}/{x}")) == 1 for x in os.listdir(shared) if x.startswith("pipeline-"))


def test_stages_keep_columns(spark, small):
    import corpus_pipeline

    docs = table(spark, small, "documents").withColumns({"__row": F.lit("own"), "row_key": F.col("doc_id") + 1, "cell": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_language_fit_ignores_held_out(spark, medium):
    from newsloom.llm.common import held_out

    docs = table(spark, medium, "documents").select("text", "lang", "doc_id")
    taught = docs.where(~held_out())
    noisy = taught.unionByName(docs.where(held_out()).withColumn("lang", F.lit(None).cast("string")))
    assert np.allclose(langid.fit(taught).prototypes, langid.fit(noisy).prototypes)


# --- source divergence


def test_divergence(spark, duck, medium):
    """All rows against plain SQL over all (source, term) pairs."""
    cols = ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, queries.op12_divergence(spark, medium).select(cols).collect()))
    assert got == sorted(duck.execute(queries.SQL["op12_divergence"]).df()[cols].itertuples(index=False, name=None))


def test_divergence_odd(spark):
    """Null languages, sources and texts, groups without terms, a lone source, clashing columns, letters outside ASCII, an empty table."""
    rows = [("en", "a", "Été été THE the x1y")] * 3 + [("en", "b", "the THE")] * 2 + [("en", "c", None), (None, None, "été"), ("de", "lone", "die die"), ("de", "lone", "die")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "n": F.lit("x"), "doc_id": F.lit(None)})
    got = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in divergence.audit(docs, least=2).collect()}
    n = {"a": {"été": 3, "Été": 0, "the": 6, "x": 3, "y": 3}, "b": {"the": 4}, "c": {}}
    terms = ["the", "x", "y", "été", "Été"]
    n["a"] = {"the": 6, "x": 3, "y": 3, "été": 3, "Été": 3}  # only A-Z are lower-cased
    share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(terms))
    p = {s: {t: share(c.get(t, 0), sum(c.values())) for t in terms} for s, c in n.items()}
    for s in n:
        others = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in n if o != s))
        for rank, (value, o) in enumerate(others, 1):
            assert got["en", s, "pair", o] == (-value, rank)
        total = {t: sum(c.get(t, 0) for c in n.values()) for t in terms}
        q = {t: share(total[t], sum(total.values())) for t in terms}
        marked = sorted(((q[t] - p[s][t], t.encode(), t) for t in terms if n[s].get(t) and p[s][t] > q[t]))
        assert [(k[3], v) for k, v in sorted(got.items(), key=lambda x: x[1][1]) if k[:3] == ("en", s, "term")] == [(t, (-f, i)) for i, (f, _, t) in enumerate(marked, 1)]
    assert not [k for k in got if k[0] != "en" and k[2] == "pair"]
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_bounds(spark, medium, monkeypatch):
    """Small bounds on what tasks hold change nothing."""
    docs = table(spark, medium, "documents").limit(300)
    whole = sorted(map(tuple, divergence.audit(docs, least=5).collect()))
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 20)
    monkeypatch.setattr(divergence, "LOT", 40)
    assert sorted(map(tuple, divergence.audit(docs, least=5).collect())) == whole


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab1 c'dé  x-YZ ".encode() * 40
    whole = [t for part in terms.lists(text, terms.WORDS) for t in part]
    monkeypatch.setattr(terms, "PIECE", 7)
    assert [t for part in terms.lists(text, terms.WORDS) for t in part] == whole
    assert whole[:6] == [b"ab1", b"c", "dé".encode(), b"x", b"yz", b"ab1"]


# --- ranked lexical search


def lexical_by_hand(docs, items, k=50):
    """Every document scored against every item."""
    import math
    from collections import Counter

    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            score = 0
            for t in set(words(text)) & b.keys():
                m = 50 + 50 * b.total() * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_lexical(spark, duck, medium):
    cols = ["item_id", "rank", "doc_id", "score"]
    got = sorted(map(tuple, queries.op13_lexical(spark, medium).select(cols).collect()))
    assert got == sorted(duck.execute(queries.SQL["op13_lexical"]).df()[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("lot", [1, 4000])
def test_lexical_odd(spark, lot, monkeypatch):
    """Nulls, ties, repeated rows and items, missing ids, very long texts, clashing columns, small shards, several lots."""
    monkeypatch.setattr(lexical, "SHARD_ROWS", 7)
    monkeypatch.setattr(lexical, "SHARD_PARTS", 2)
    rng = np.random.default_rng(5)
    vocabulary = ["Éa", "b", "c1", "7", "straße", "the", "x"]
    docs = [(i % 40, " ".join(rng.choice(vocabulary, rng.integers(0, 12)))) for i in range(120)]
    docs += [(None, "b c1 the"), (None, None), (500, None), (501, ""), (502, "B-c1\x00THE"), (502, "b c1 the"), (-3, "b c1 the"), (600, "the " * 500_000 + "x")]
    items = [(1, "b the The éa ÉA"), (1, "b the The éa ÉA"), (2, None), (3, ""), (4, "nowhere"), (None, "x 7 straße"), (5, "c1, b; the...")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("r"), "item": F.lit(1), "task": F.lit(2), "score": F.lit(None)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = sorted(map(tuple, lexical.search(frame, asked, k=9, lot=lot).collect()), key=str)
    assert got == lexical_by_hand(docs, items, 9)
    assert lexical.search(frame.limit(0), asked).count() == lexical.search(frame, asked.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12))
def test_wand_equals_all_scores(seed, k):
    """The heap holds the best of all documents, and documents are skipped."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    postings, whole = [], np.zeros(n, int)
    for _ in range(int(rng.integers(1, 9))):
        own = np.flatnonzero(rng.random(n) < rng.random() ** 2)
        impact = rng.integers(1, int(rng.integers(2, 50)), len(own))
        whole[own] += impact
        if len(own):
            postings.append((own.tolist(), impact.tolist(), int(impact.max())))
    ids, heap = rng.permutation(n).tolist(), []
    scored = lexical.walk(postings, ids, heap, k)
    expected = sorted(((s, -i) for s, i in zip(whole.tolist(), ids) if s), reverse=True)[:k]
    assert sorted(heap, reverse=True) == expected
    assert scored <= np.count_nonzero(whole)


def test_wand_skips():
    common, rare = list(range(10_000)), list(range(0, 10_000, 500))
    heap = []
    assert lexical.walk([(common, [1] * 10_000, 1), (rare, [50] * 20, 50)], common, heap, 3) < 1_050  # up to the third rare one, then rare ones only
    assert sorted(heap) == [(51, -1000), (51, -500), (51, 0)]


# --- exact search with M-trees


def exact_by_hand(rows, k=5, every=50):
    """Integer products of all pairs; an id's best vector counts."""
    whole = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    size = Counter(len(v) for _, v in whole).most_common(1)[0][0] if whole else 0
    whole = [(i, v) for i, v in whole if len(v) == size]
    out = []
    for q in {i for i, _ in whole if i % every == 0}:
        best = {}
        for i, v in whole:
            if i != q:
                best[i] = max(best.get(i, -(10**18)), *(sum(a * b for a, b in zip(u, v)) for j, u in whole if j == q))
        out += [(q, rank, i, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_exact_search(spark, duck, medium):
    cols = ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, queries.op11_exact(spark, medium).select(cols).collect()))
    assert got == sorted(duck.execute(queries.SQL["op11_exact"]).df()[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("few", [False, True])
def test_exact_search_odd(spark, few):
    """Nulls, no numbers, another length, zero and equal vectors, repeated rows and ids, one vector in a third of the rows, many small trees."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6)) * 4
    rows = [(int(i), (centres[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)] + [(50, rows[9][1]), (50, rows[9][1]), (3, rows[4][1]), (400, [0.0] * 6), (401, [-x for x in rows[0][1]])]
    rows += [(None, rows[1][1]), (500, None), (550, []), (600, [1.0] * 5), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [math.nan] * 6), (750, [math.inf] + [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "tree": F.lit("t"), "score": F.lit(0), "ids": F.lit(None)})
    s = mtree.Settings(page=4, tree_rows=20, root_block=3, query_block=2) if few else mtree.Settings()
    got = mtree.search(frame, F.col("vec_id") % 50 == 0, settings=s)
    assert sorted(tuple(r)[:4] for r in got.collect()) == exact_by_hand(rows)
    assert mtree.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == mtree.search(frame, F.lit(False)).count() == 0
    lone = mtree.search(frame.where("vec_id = 0 or vec_id = 1"), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in lone] == [(0, 1)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 6))
def test_tree_bounds_hold(seed, page, dim):
    """Radii cover the subtrees, stored distances are right, and the search equals all products."""
    rng = np.random.default_rng(seed)
    v = np.unique(rng.integers(-30, 30, (int(rng.integers(1, 200)), dim)), axis=0)
    space = mtree.Space(dim, float((v * v).sum(1).max()))
    pages = mtree.build(space, v, [[i] for i in range(len(v))], page)

    def below(at):
        p = pages[at]
        own = p.vectors if p.level == 0 else np.concatenate([below(c) for c in p.children])
        away = np.sqrt(((space.lifted(own) - space.lifted(p.centre[None])) ** 2).sum(1))
        assert np.isclose(away.max(), p.cover) and len(p.vectors) <= page
        assert np.allclose(np.sqrt(((space.lifted(p.vectors) - space.lifted(p.centre[None])) ** 2).sum(1)), p.apart)
        assert all(np.isclose(p.reach[i], pages[c].cover) for i, c in enumerate(p.children))
        return own

    assert sorted(map(tuple, below(len(pages) - 1))) == sorted(map(tuple, v))
    q, k = rng.integers(-40, 40, dim), int(rng.integers(1, 8))
    found, computed = mtree.best_first(space, pages, q, k)
    assert found == sorted(((int(x @ q), i) for i, x in enumerate(v)), key=lambda x: (-x[0], x[1]))[:k]
    floor = found[-1][0]
    assert mtree.best_first(space, pages, q, k, floor)[0] == found


def test_tree_saves_products():
    """Clustered vectors: most are never multiplied."""
    rng = np.random.default_rng(0)
    v = np.unique((rng.normal(size=(80, 16))[rng.integers(0, 80, 8000)] * 100 + rng.normal(size=(8000, 16)) * 5).astype(int), axis=0)
    space = mtree.Space(16, float((v * v).sum(1).max()))
    pages = mtree.build(space, v, [[i] for i in range(len(v))], 64)
    computed = [mtree.best_first(space, pages, q, 5)[1] for q in v[::400]]
    assert np.mean(computed) < 0.2 * len(v)
