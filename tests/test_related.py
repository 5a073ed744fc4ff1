"""Related titles against all pairs, and the bounds that prune them."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.operators import related as R
from newsloom.plans.registry import QUERIES
from newsloom.sources.tables import items


def all_pairs(rows, ratio=0.8):
    """{(left, right): ratio} of (id, source, title) rows; the earlier one is matched in the later one."""
    out = {}
    for n, (i, source, title) in enumerate(sorted(rows)):
        for j, other_source, other in sorted(rows)[n + 1 :]:
            if source != other_source and 2 * min(len(title), len(other)) >= ratio * (len(title) + len(other)):
                match = difflib.SequenceMatcher(None, title, other)
                if match.quick_ratio() >= ratio and match.ratio() >= ratio:
                    out[i, j] = match.ratio()
    return out


def test_cross_links_lose_no_pair(spark, medium):
    first: dict[tuple, int] = {}
    for r in items(spark, medium).select("source_id", "title", "item_id").collect():
        if len(r["title"]) >= 24:
            key = (r["source_id"], r["title"])
            first[key] = min(first.get(key, r["item_id"]), r["item_id"])
    expected = set(all_pairs([(i, *key) for key, i in first.items()]))
    got = {(r["item_id"], r["other_id"]) for r in QUERIES["cross_links"](spark, medium).collect()}
    assert len(expected) > 100 and got == expected | {(j, i) for i, j in expected}


@pytest.mark.parametrize("block, chars", [(2048, 4_000_000), (5, 4_000_000), (100, 300)])
def test_alike_in_small_chunks(spark, block, chars):
    """However bands are cut, every pair is found once; near copies of many lengths, with edits anywhere."""
    rng = random.Random(4)
    texts = []
    for _ in range(14):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 12, 30, 90, 240])))
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 4))):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice([0, 1, 1])] = [rng.choice("abcdefghé😀 ")] * rng.choice([0, 1, 1])
            texts.append("".join(own) or "x")
    rows = [(i, str(i), t) for i, t in enumerate(dict.fromkeys(texts))]
    got = R.alike(spark.createDataFrame([(i, t) for i, _, t in rows], "id long, text string"), block=block, chars=chars).collect()
    assert {(r["left_id"], r["right_id"]): r["ratio"] for r in got} == all_pairs(rows) and len(got) == len(all_pairs(rows)) > 30


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=60), st.integers(0, 10**9))
def test_bounds_hold(text, seed):
    """Every pair at the ratio passes every bound, so none is lost."""
    rng, other = random.Random(seed), list(text)
    for _ in range(rng.randint(0, len(text) // 3)):
        other[rng.randrange(len(other) + 1) :][:1] = rng.choice("abcdx")
        at = rng.randrange(len(other) + 1)
        other[at : at + 1] = rng.choice(["", "x", "ab"])
    other = "".join(other) or "z"
    found = [r for *_, r in R.compared([1, 2], [text, other], None, 0.8)]
    real = R.ratio_of(text, other)
    assert found == ([real] if real >= 0.8 else [])
    best = [[0] * (len(other) + 1) for _ in range(len(text) + 1)]
    for i, a in enumerate(text):
        for j, b in enumerate(other):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    assert R.common_subsequence(R.places_of(text), len(text), other) == best[-1][-1]


def test_related_by_title_and_cycle(spark):
    """Both directions, other sources only, cycles whatever the title, nulls, short titles, repeated titles."""
    rows = [(1, "a", "The spring call for young doctors opens", "2026-1"), (2, "b", "the spring call for young doctors opens! ", None), (3, "a", "The spring call for young doctors opens", None), (4, "a", "The spring call for young doctors opened", None),
            (5, "c", "Results", "2026-1"), (6, "c", "Results", "2026-1"), (7, "d", None, ""), (8, None, "The spring call for young doctors opens", None), (9, "e", "something else entirely, with no like", "2027-2")]
    got = {(r["item_id"], r["other_id"]): r["by"] for r in R.related(spark.createDataFrame(rows, "item_id long, source_id string, title string, cycle string"), cycle_col="cycle").collect()}
    one_way = {(1, 2): "title", (2, 4): "title", (1, 8): "title", (2, 8): "title", (4, 8): "title", (1, 5): "cycle", (1, 6): "cycle"}
    assert got == one_way | {(b, a): by for (a, b), by in one_way.items()}
    assert R.related(spark.createDataFrame([], "item_id long, source_id string, title string")).count() == 0


def test_pairs_are_judged_where_they_meet(spark, small):
    """Candidates of related_pairs are neither kept nor shuffled: no step over pairs follows the join that makes them."""
    plan = QUERIES["related_pairs"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(left_id" not in plan and "hashpartitioning(right_id" not in plan and "Aggregate(keys=[left_id" not in plan


def test_packs_find_what_single_texts_do():
    """Common subsequences with many texts at once, texts of one character and carries over whole texts among them."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é😀") for _ in range(rng.choice([1, 2, 63, 64, 65, 200]))) for _ in range(150)] + ["a" * 64, "a" * 65]
    pack = R.Pack(texts)
    for other in [*texts[:20], "a" * 300, "zz"]:
        masks = R.places_of(other)
        assert pack.common(other, range(len(texts))) == [R.common_subsequence(masks, len(other), t) for t in texts]
    cuts = R._packs([*texts, "x" * 100_000, "y"])
    assert cuts[0] == 0 and cuts[-1] == 154 and all(0 < b - a <= R.PACK for a, b in zip(cuts, cuts[1:], strict=False))


def syllables(rng, size, words=("th", "the", "ing", "er", "on", "and", "re", "ha", "st", "ou", "ly", "wh", "tion", "ble")):
    out = ""
    while len(out) < size:
        out += rng.choice(words) + rng.choice(["", "", " ", ", "])
    return out[:size]


def test_bounds_hold_for_long_texts():
    """From 200 characters on frequent characters start no block; pairs about the ratio, of few and of many kinds of characters, on either side of that length."""
    rng, near = random.Random(11), 0
    for k in range(400):
        size = rng.choice([190, 199, 200, 205, 300, 420, 900])
        base = syllables(rng, size) if k % 4 else "".join(chr(0x4E00 + rng.randrange(rng.choice([5, 60, 3000]))) for _ in range(size))
        other = list(base)
        for _ in range(int(size * rng.choice([0.02, 0.1, 0.18, 0.22]))):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice(["", "x", "e", "qz"])
        if k % 3 == 0:  # pieces in one go: few blocks
            cut = int(size * rng.choice([0.15, 0.19, 0.2, 0.21]))
            other = list(base[:-cut] + syllables(rng, cut))
        other = "".join(other)
        for a, b in ((base, other), (other, base)):
            real = R.ratio_of(a, b)
            near += 0.75 < real < 0.85
            for side in (None, [True, False]):
                assert [r for *_, r in R.compared([1, 2], [a, b], side, 0.8)] == ([real] if real >= 0.8 else [])
                assert [r for *_, r in R.compared([2, 1], [b, a], side, 0.8)] == ([real] if real >= 0.8 else [])
    assert near > 60


def test_few_long_pairs_reach_the_common_subsequence(monkeypatch):
    """Unlike texts of one language go by counts of runs; all 19,900 pairs went on before."""
    rng, seen = random.Random(5), []
    texts = [syllables(rng, rng.randrange(300, 340)) for _ in range(200)]
    texts[7] = texts[3][:150] + "?" + texts[3][150:]
    single, pack = R.common_subsequence, R.Pack.common
    monkeypatch.setattr(R, "common_subsequence", lambda *a: seen.append(1) or single(*a))
    monkeypatch.setattr(R.Pack, "common", lambda self, other, which: seen.extend(which) or pack(self, other, which))
    assert [(a, b) for a, b, _ in R.compared(list(range(200)), texts, None, 0.8)] == [(3, 7)] and 1 <= len(seen) < 200


def test_large_blocks_are_split(spark, tmp_path):
    """Pairs of word sets against all pairs, with words that many sets have, near copies of one title and sets of one and two words; large blocks leave few pairs."""
    from pyspark.sql import functions as F

    from newsloom.plans import texts

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfgklm") + rng.choice("aiou") for _ in range(3)) for _ in range(60)]
    sets = [set(rng.sample(vocabulary, rng.choice([1, 2, 2, 3, 4, 5, 8, 8, 12, 20]))) for _ in range(600)]
    base = set(vocabulary[:25])
    sets += [base - set(rng.sample(sorted(base), 2)) | {rng.choice(vocabulary)} for _ in range(50)]
    spark.createDataFrame([(i, " ".join(sorted(s)) + "\nrest") for i, s in enumerate(sets)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first: dict[frozenset, int] = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    expected = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.5}
    got = [(r["left_id"], r["right_id"]) for r in texts.related_pairs(spark, str(tmp_path)).collect()]
    assert len(expected) > 1_000 and len(got) == len(set(got)) and set(got) == expected

    # words 0 to 19 are in a third of the sets each, beside words of their own
    rows = [(i, sorted({1_000 + 7 * i + k for k in range(4)}) + sorted(rng.sample(range(20), 7))) for i in range(500)]
    ordered = spark.createDataFrame([(i, ws, len(ws)) for i, ws in rows], "id long, ws array<long>, n int")
    blocks = texts._title_blocks(ordered, 0.5).groupBy("word", "second").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
    unsplit = texts._title_blocks(ordered, 0.5, most=1_000).groupBy("word", "second").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
    assert 0 < blocks < unsplit / 2
