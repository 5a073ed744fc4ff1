"""Text functions, topic tags, feature flags and the small logistic model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import normalise
from ..functions.rules import first_match
from ..sources.shared import written
from ..sources.tables import load, log
from .registry import query

_FOLDED = f"translate(lower(replace(%s, 'İ', 'i')), '{T.ACCENTED}', '{T.PLAIN}')"
_TOKENS = f"list_filter(regexp_split_to_array({_FOLDED}, '[^a-z0-9]+'), lambda w: length(w) BETWEEN 3 AND 24 AND w NOT IN {T.STOP_WORDS} AND NOT regexp_matches(w, '^[0-9]+$'))"
BUCKETS = 4096


@query(r"""SELECT doc_id, length(text) AS chars, len(string_split_regex(text, '\s+')) AS words, len(regexp_extract_all(text, '[.!?]+(\s|$)')) AS sentences,
 CASE WHEN text = '' THEN 'empty' WHEN len(regexp_extract_all(text, '[.!?]+(\s|$)')) = 0 THEN 'no_sentence' WHEN len(string_split_regex(text, '\s+')) < 20 THEN 'short' ELSE 'ok' END AS contract FROM documents""")
def text_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words and sentences, and the first rule of the contract that a text breaks."""
    t = F.col("text")
    words, ends = F.size(F.split(t, r"\s+")), T.sentences(t)
    rules = [("empty", t == ""), ("no_sentence", ends == 0), ("short", words < 20)]
    return load(spark, sf_dir, "documents").select("doc_id", F.char_length(t).cast("long").alias("chars"), words.cast("long").alias("words"), ends.cast("long").alias("sentences"), first_match(rules, "ok").alias("contract"))


@query(f"""SELECT doc_id, translate(lower(replace(text, 'İ', 'i')), '{T.ACCENTED}', '{T.PLAIN}') AS folded FROM documents""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without case and accents."""
    return load(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(translate(lower(replace(text, 'İ', 'i')), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+')) AS w FROM documents)
SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE length(w) BETWEEN 3 AND 24 AND w NOT IN {T.STOP_WORDS} AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY w HAVING count(*) >= 20""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts that occur 20 times or more, with their documents."""
    w = load(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 20")


_STEM_SQL = """WITH w AS (SELECT DISTINCT unnest(%s) AS w FROM documents), c AS (SELECT CASE WHEN length(w) > 4 AND w LIKE '%%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 5 AND w LIKE '%%ing' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%%ed' THEN left(w, length(w) - 2)
 WHEN length(w) > 4 AND regexp_matches(w, '(ss|sh|ch|x|z)es$') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND regexp_matches(w, '[^sui]s$') THEN left(w, length(w) - 1) ELSE w END AS c FROM w)
SELECT CASE WHEN length(c) > 3 AND right(c, 1) = substr(c, length(c) - 1, 1) AND contains('bcdghjkmnpqrtvwxy', right(c, 1)) THEN left(c, length(c) - 1) ELSE c END AS stem, count(*) AS words FROM c GROUP BY 1"""


@query(_STEM_SQL % (_TOKENS % "text"))
def token_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems with the number of words that share them."""
    w = load(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return w.groupBy(T.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("words"))


@query(r"""SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS has_year, regexp_matches(text, '@[a-z0-9.]+') AS has_mail, regexp_matches(text, '(?i)licensed under') AS has_licence, regexp_matches(text, '[|]') AS has_table, regexp_matches(text, '!!') AS has_shout,
 CASE WHEN regexp_matches(text, '!!') THEN 'shout' WHEN regexp_matches(text, '[|].*[|].*[|]') THEN 'table' WHEN regexp_matches(text, '@[a-z0-9.]+') THEN 'personal' ELSE 'pass' END AS gate FROM documents""")
def feature_flags_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a text and the first gate that stops it; one projection, no UDF."""
    t = F.col("text")
    year, mail, licence, table, shout = (t.rlike(p) for p in ("[0-9]{4}", "@[a-z0-9.]+", "(?i)licensed under", "[|]", "!!"))
    gate = first_match([("shout", shout), ("table", t.rlike("[|].*[|].*[|]")), ("personal", mail)], "pass")
    return load(spark, sf_dir, "documents").select("doc_id", year.alias("has_year"), mail.alias("has_mail"), licence.alias("has_licence"), table.alias("has_table"), shout.alias("has_shout"), gate.alias("gate"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS high, coalesce(json_extract_string(props, '$.note'), 'none') AS note FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column by path, with a fallback for those that are absent."""
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select("event_id", k.alias("k"), (k > 50).alias("high"), F.coalesce(F.get_json_object("props", "$.note"), F.lit("none")).alias("note"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 2 THEN strftime(o_orderdate, '%Y %b %-d') WHEN 3 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m') WHEN 5 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') END AS printed,
 CASE o_orderkey % 7 WHEN 4 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 5 THEN CAST(date_trunc('year', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS read FROM orders""")
def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed in seven ways, read back; the day they stand for is beside them."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    forms = ("yyyy-MM-dd", "yyyy-M-d", "yyyy MMM d", "d MMM yyyy", "yyyy-MM", "yyyy", "EEE, dd MMM yyyy HH:mm:ss")
    printed = F.element_at(F.array(*(F.date_format(F.col("day").cast("timestamp"), f) for f in forms)), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    rows = o.select("o_orderkey", "day", printed.alias("printed"))
    return rows.select("*", normalise(F.col("printed")).alias("read"))


@query("""SELECT doc_id, 'https://www.example.com/a/' || CAST(doc_id % 50 AS VARCHAR) || '/?utm_source=x&b=2&a=1#top' AS url, 'example.com/a/' || CAST(doc_id % 50 AS VARCHAR) || '?a=1&b=2' AS url_key FROM documents""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs and the key under which equal pages meet."""
    u = F.concat(F.lit("https://www.example.com/a/"), (F.col("doc_id") % 50).cast("string"), F.lit("/?utm_source=x&b=2&a=1#top"))
    return load(spark, sf_dir, "documents").select("doc_id", u.alias("url")).select("doc_id", "url", T.url_key(F.col("url")).alias("url_key"))


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, bucket) of the hashed words and word pairs of whole texts, each bucket once; a bucket is the end of a word's MD5."""
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("words"))
    feats = F.array_distinct(F.transform(F.array_distinct(F.concat("words", T.bigrams(F.col("words")))), lambda w: F.conv(F.right(F.md5(w.cast("binary")), F.lit(3)), 16, 10).cast("long")))
    return words.select("doc_id", F.explode(feats).alias("bucket"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part) SELECT w AS word, length(w) AS n FROM w WHERE w <> ''""")
def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of names."""
    w = load(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z0-9]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", F.length("word").cast("long").alias("n"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part), h AS (SELECT w, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM w WHERE w <> '')
SELECT w AS word, h AS hash, h % 4096 AS bucket FROM h""")
def feature_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names by their FNV-1a bucket, as models of the older form address them."""
    w = load(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z0-9]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", T.fnv1a(F.col("word")).alias("hash"), (T.fnv1a(F.col("word")) % BUCKETS).alias("bucket"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS % "text"} AS w FROM documents), f AS (SELECT doc_id, list_distinct(list_transform(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), lambda x: CAST('0x' || right(md5(x), 3) AS BIGINT))) AS b FROM t), u AS (SELECT doc_id, unnest(b) AS b FROM f)
SELECT doc_id, round(1 / (1 + exp(-sum(sin(b * 0.37) * 0.2))), 6) AS score FROM u GROUP BY doc_id""")
def hashed_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic scores of all documents under fixed small weights: features joined with a table of 4,096 weights."""
    weights = spark.range(BUCKETS).select(F.col("id").alias("bucket"), (F.sin(F.col("id") * 0.37) * 0.2).alias("w"))
    z = _features(load(spark, sf_dir, "documents")).join(F.broadcast(weights), "bucket").groupBy("doc_id").agg(F.sum("w").alias("z"))
    return z.select("doc_id", F.round(1 / (1 + F.exp(-F.col("z"))), 6).alias("score"))


@query()
def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold validation of the small model, and whether it may be activated."""
    return _validated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def _validated(docs: DataFrame, labels: DataFrame, most: int = 4_000, epochs: int = 40, least: int = 30) -> DataFrame:
    """(fold, n, accuracy, mae, active) of a logistic model over hashed words, trained by gradient steps in the order of the ids.

    The ``i``-th rating is tested in fold ``i % 5``. Training takes the ratings one after the other, so a fold is one task, and
    ``most`` bounds the ratings (the first by a hash of the id). A model may be active with ``least`` ratings and an accuracy that is not worse than
    that of always answering the commoner label.
    """
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id")).limit(most)
    rows = _features(docs.select("doc_id", "text").join(labels, "doc_id")).groupBy("doc_id").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")).join(labels, "doc_id")
    rows = rows.withColumn("fold", F.explode(F.array(*(F.lit(i) for i in range(5)))))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, w = group.sort_values("doc_id").reset_index(drop=True), np.zeros(BUCKETS + 1)
        tested = group.index.to_numpy() % 5 == key[0]
        x, y = [np.append(b, BUCKETS).astype(int) for b in group["buckets"]], group["quality"].to_numpy(float)
        for epoch in range(epochs):
            rate = 0.2 / (1 + 0.2 * epoch)
            for i in np.flatnonzero(~tested):
                w[x[i]] -= rate * (1 / (1 + np.exp(-w[x[i]].sum())) - y[i] + 0.001 * w[x[i]])
        p, label = np.array([1 / (1 + np.exp(-w[x[i]].sum())) for i in np.flatnonzero(tested)]), y[tested]
        some = len(label) > 0
        accuracy, usual = (float(((p >= 0.5) == label).mean()), float(max(label.mean(), 1 - label.mean()))) if some else (None, None)
        return pd.DataFrame({"fold": [key[0]], "n": [len(label)], "accuracy": [accuracy], "mae": [float(np.abs(p - label).mean()) if some else None], "active": [bool(some and len(y) >= least and accuracy >= usual)]})

    return rows.groupBy("fold").applyInPandas(run, "fold int, n long, accuracy double, mae double, active boolean")


@query(f"""WITH t AS (SELECT doc_id, list_sort(list_distinct({_TOKENS % "split_part(text, chr(10), 1)"})) AS words FROM documents), c AS (SELECT min(doc_id) AS id, words, count(*) AS items, len(words) AS n FROM t WHERE len(words) > 0 GROUP BY words), w AS (SELECT id, n, items, unnest(words) AS word FROM c),
 p AS (SELECT l.id AS left_id, r.id AS right_id, l.items AS left_items, r.items AS right_items, CAST(count(*) AS DOUBLE) / (l.n + r.n - count(*)) AS share FROM w l JOIN w r USING (word) WHERE l.id < r.id GROUP BY l.id, r.id, l.items, r.items, l.n, r.n)
SELECT left_id, right_id, left_items, right_items, round(share, 4) AS similarity FROM p WHERE share >= 0.5""")
def related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different titles of which at least half the words are common: class representatives and how many items each stands for.

    Equal word sets are one class before any join. Words are ordered by rarity over all classes; a pair with a
    share of one half must meet in the rarest half (and one) of either side, so only those words open blocks. A block of many classes is split by the next
    word that they have, which must be common too, unless that leaves as many pairs. A class goes to its blocks
    with all its words, as numbers; a pair is judged in the block of its first common words, so no candidates are kept, shuffled or made distinct.
    """
    least = 0.5
    t = load(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(T.tokens(F.split_part("text", F.lit("\n"), F.lit(1))))).alias("words")).where(F.size("words") > 0)
    classes = t.groupBy("words").agg(F.min("doc_id").alias("id"), F.count("*").alias("items"))
    w = classes.select("id", "items", F.explode("words").alias("word"))
    counts = written(w.groupBy("word").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id()))
    ordered = w.join(counts, "word").groupBy("id").agg(F.max("items").alias("items"), F.transform(F.array_sort(F.collect_list(F.struct("df", "number"))), lambda x: x["number"]).alias("ws"))
    ordered = written(ordered.withColumn("n", F.size("ws")))
    blocks = _title_blocks(ordered, least).join(ordered, "id")
    l, r = (blocks.select("word", "second", F.col("id").alias(f"{s}_id"), F.col("items").alias(f"{s}_items"), F.col("ws").alias(f"{s}_ws"), F.col("n").alias(f"{s[0]}n"), F.col("place").alias(f"{s[0]}p")) for s in ("left", "right"))  # noqa: E741
    near = (F.col("left_id") < F.col("right_id")) & (F.least("ln", "rn") >= F.lit(least) * F.greatest("ln", "rn"))
    # words are ordered alike on both sides and a pair counts at its first common one, so what can be common is this word and the rest of the shorter side
    near = near & (1 + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) >= F.ceil(F.lit(least / (1 + least)) * (F.col("ln") + F.col("rn"))))
    common, share = F.array_intersect("left_ws", "right_ws"), lambda c: F.size(c) / (F.col("ln") + F.col("rn") - F.size(c))
    first = lambda c: (F.get(c, F.lit(0)) == F.col("word")) & ((F.col("second") == -1) | (F.get(c, F.lit(1)) == F.col("second")))
    # an array of one, so that the common words are found once a pair
    pairs = l.join(r, ["word", "second"]).where(near & F.exists(F.array(common), lambda c: (share(c) >= least) & first(c)))
    return pairs.select("left_id", "right_id", "left_items", "right_items", F.round(share(common), 4).alias("similarity"))


def _title_blocks(ordered: DataFrame, least: float, most: int = 32) -> DataFrame:
    """(id, place, word, second): the blocks of each class; ``second`` is -1 where the word's block is not split.

    A block of more than ``most`` classes is split by the second common word where that leaves fewer pairs; near copies of one title stay
    together, as they have all their words in common. Sets of one and of two words may have one common word alone, so they meet in the
    word's own block too. Blocks of one class are left out.
    """
    reach = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    prefix = ordered.select("id", "n", "ws", F.posexplode(F.slice("ws", 1, reach.cast("int"))).alias("place", "word")).withColumn("place", F.col("place") + 1)
    sizes = written(prefix.groupBy("word").agg(F.count("*").alias("k")).where("k > 1"))
    large = sizes.where(F.col("k") > most)
    tail = F.slice("ws", F.col("place") + 1, F.greatest(reach + 1 - F.col("place"), F.lit(0)).cast("int")).alias("tail")
    twos = prefix.select("word", "id", "place", tail).join(large, "word").select("word", F.explode("tail").alias("second"), F.struct("id", "place").alias("who"))
    twos = written(twos.groupBy("word", "second").agg(F.collect_list("who").alias("who")).where(F.size("who") > 1))
    left = twos.groupBy("word").agg(F.sum(F.size("who").cast("long") * (F.size("who") - 1)).alias("left"))
    split = written(large.join(left, "word", "left").where(F.coalesce(F.col("left"), F.lit(0)) < F.col("k") * (F.col("k") - 1)).select("word"))
    alone = prefix.select("id", "n", "place", "word")
    whole = alone.join(sizes.select("word"), "word", "left_semi").join(split, "word", "left_anti").unionAll(alone.where("n <= 2").join(split, "word", "left_semi"))
    parts = twos.join(split, "word", "left_semi").select("word", "second", F.explode("who").alias("who")).select("who.id", "who.place", "word", "second")
    return whole.select("id", "place", "word", F.lit(-1).cast("long").alias("second")).unionAll(parts)


@query("SELECT event_id, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN true ELSE false END AS changed FROM events")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row differs from the one before, nulls compared as values."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return log(spark, sf_dir).select("event_id", "user_id", (~before.eqNullSafe(F.col("event_type"))).alias("changed"))
