"""Chat formatting from event logs, with DataFrame functions only.

A conversation is a log of events (conv, message, seq, event, turn, role, text): a ``delta`` appends
its text to its message, an ``edit`` or ``regenerate`` starts it anew with its own text, and a
regeneration also withdraws later turns that were last touched before it. ``fold`` deals the log by
conversation, sorts by sequence and folds the events into final messages; ``render`` writes them in
one template; ``read_back`` takes role, text and loss back out of the written form.

Template: ``<|turn|>role<|text|>body<|end|>`` and, where the body is learnt, ``<|learn|>`` in place
of ``<|text|>``. Control strings of this and of other common templates get a backslash after their
first character, and backslashes are doubled, so every text comes back as it was.

Null roles and texts are empty; a null event is a delta. Events with equal seq go by event, then
text; messages with equal turn go by role, then text. Repeated rows stay separate messages unless
they name the same message. A conversation is one output row, so its messages meet in one task by
contract: they are dealt once, sorted with spilling, and only then joined. Rows without a
conversation id form one conversation. An empty log gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNT = "assistant"
TURN, TEXT, LEARN, END = "<|turn|>", "<|text|>", "<|learn|>", "<|end|>"
#: Openings of control strings, here and in public chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
RESETS = ("edit", "regenerate")


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROLS:
        out = F.replace(out, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the final messages of a log (conv_id, message, seq, event, turn, role, text)."""
    event = F.coalesce("event", F.lit("delta"))
    log = events.select("conv_id", "message", "seq", event.alias("event"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    told = F.array_sort(F.collect_list(F.struct("seq", "event", "text")))
    messages = log.groupBy("conv_id", "message").agg(F.min("turn").alias("turn"), F.max("role").alias("role"), F.max("seq").alias("last"), F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("redone"), told.alias("told"))
    reset = F.array_max(F.transform("told", lambda x, i: F.when(x["event"].isin(*RESETS), i).otherwise(0)))
    text = F.array_join(F.transform(F.slice("told", reset + 1, F.size("told")), lambda x: x["text"]), "")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    redone = F.max("redone").over(earlier)
    return messages.select("conv_id", "turn", "role", text.alias("text"), "last", redone.alias("redone")).where("redone is null or last >= redone").drop("last", "redone")


def render(messages: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """(conv_id, formatted, loss_spans): one text for each conversation, and (start, length) code points that are learnt."""
    learn = F.col("role") == learnt
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.when(learn, LEARN).otherwise(TEXT))
    rows = messages.withColumn("head", head).withColumn("body", escape(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(END)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.select("conv_id", number.alias("i"), F.concat("head", "body", F.lit(END)).alias("piece"), F.when(learn, F.struct((F.coalesce(F.sum(size).over(order), F.lit(0)) + F.char_length("head")).alias("start"), F.char_length("body").alias("length"))).alias("span"))
    put = F.array_sort(F.collect_list(F.struct("i", "piece", "span")))
    return rows.groupBy("conv_id").agg(put.alias("put")).select("conv_id", F.array_join(F.transform("put", lambda x: x["piece"]), "").alias("formatted"), F.array_compact(F.transform("put", lambda x: x["span"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text,learnt>>, formatted) parsed from the written form alone."""
    def part(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)^(.*?)<\|(?:text|learn)\|>", 1)
        body = F.regexp_extract(p, r"(?s)<\|(?:text|learn)\|>(.*)<\|end\|>$", 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"), F.contains(p, F.lit(LEARN)).alias("learnt"))

    parts = F.split("formatted", r"<\|turn\|>")
    parts = F.slice(parts, 2, F.size(parts))
    return formatted.select("conv_id", "formatted", F.transform(parts, part).alias("turns"))


def digests(read: DataFrame) -> DataFrame:
    """The checked figures of each conversation, from what was read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: t["text"]), "")
    rows = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log that leads to them, as a streaming chat service writes it.

    A learnt role's message begins with a draft and a follow-up by the user, is regenerated (which
    withdraws draft and follow-up) and streams in three deltas; other messages begin with a draft that an edit
    replaces by the first third, and go on with two deltas. ``seq`` counts from ten times the turn; a null turn counts as 0. The
    log is unordered: a message's events come last first.
    """
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    first, second = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    thirds = [F.left(text, first), F.substr(text, first + 1, second - first), F.substr(text, second + 1, n - second)]
    rows = conversations.select("conv_id", (F.monotonically_increasing_id() * 2).alias("message"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def event(seq: int, kind: str, told: Column, follow_up: bool = False) -> Column:
        return F.struct((F.col("message") + int(follow_up)).alias("message"), (F.coalesce("turn", F.lit(0)) * 10 + seq).alias("seq"), F.lit(kind).alias("event"), (F.col("turn") + int(follow_up)).alias("turn"), (F.lit("user") if follow_up else F.col("role")).alias("role"), told.alias("text"))

    draft = F.concat(F.lit("draft: "), F.left(text, F.lit(30)))
    deltas = [event(4, "delta", thirds[2]), event(3, "delta", thirds[1])]
    learnt = F.array(*deltas, event(2, "regenerate", thirds[0]), event(1, "delta", F.lit("and then?"), True), event(0, "delta", draft))
    other = F.array(*deltas, event(2, "edit", thirds[0]), event(0, "delta", draft))
    return rows.select("conv_id", F.explode(F.when(F.col("role") == LEARNT, learnt).otherwise(other)).alias("e")).select("conv_id", "e.*")
