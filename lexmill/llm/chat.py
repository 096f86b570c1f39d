r"""Chat formatting from an event log, with DataFrame functions only.

`fold_events` rebuilds messages from events (conv_id, seq, kind, message, role, text). A conversation has one
sequence, `seq`, over all its messages, whose streams may be woven into each other; an event names its message.
The log is partitioned by conversation, in stretches of the sequence, and sorted by seq; each stretch is folded,
and the folds of a message are joined in the order of their stretches. Kinds: `open` starts the message and sets
its role, `delta` appends text, `edit` replaces the text, `regenerate` discards it (deltas follow). Messages
come in the order of their first events. Events of unknown kind change nothing; at equal seq the order is kind,
role, text; a message without an event that carries a role has the empty role; null text is empty.

`render` writes each message as  <|im_start|>ROLE NEWLINE TEXT<|im_end|> NEWLINE  and joins the messages of
a conversation in their order. Inside a role or text every backslash is doubled, then a backslash is put after the
first character of every control string, and in a role a backslash before every newline, so no control
string is left and `read_back` gives the same messages again. The loss mask is a run-length list of
(code points, in loss) over the output: each assistant text, escaped, is a run under the loss.

Skew: a conversation may hold a third of all events. No task folds more of it than a stretch of STRETCH numbers
of its sequence, then the folds of one message; rendered messages are joined by stretch, and a conversation's
one task reads one row per stretch. The output is one string per conversation, so that string itself must fit
one row.

Defined cases: repeated rows of a turn are turns of their own, in the order of role, text; a null turn
comes first; a null conv_id is one conversation; a message that is null is one message; an event without seq
comes first; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of common chat templates, ours first; fixed values. None overlaps another.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = CONTROL[:2]
#: Numbers of a sequence in one stretch; turns whose rows are numbered together; code points of a streamed piece.
STRETCH, BLOCK, CHUNK = 1_024, 64, 400


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _after_reset(array: Column, resets, kept) -> Column:
    """The elements from the last one that resets on, those that are kept; what stands before it has no effect."""
    last = F.array_position(F.reverse(F.transform(array, resets)), True)
    return F.filter(F.when(last > 0, F.slice(array, -last.cast("int"), last.cast("int"))).otherwise(array), kept)


def _last_role(array: Column) -> Column:
    """The last role that isn't null, or null."""
    return F.get(F.reverse(F.filter(F.transform(array, lambda e: e.role), lambda r: r.isNotNull())), F.lit(0))


def fold_events(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, message, role, text) -> conv_id, message, at, role, text; `at` is the first seq of the message."""
    step = F.struct("seq", "kind", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = events.withColumn("stretch", F.floor(F.col("seq") / STRETCH)).repartition("conv_id", "stretch")
    logs = dealt.groupBy("conv_id", "stretch", "message").agg(F.array_sort(F.collect_list(step)).alias("log"))
    resets = lambda e: F.coalesce(e.kind.isin("edit", "regenerate"), F.lit(False))
    texts = _after_reset(F.col("log"), resets, lambda e: e.kind.isin("delta", "edit"))
    part = F.struct(F.col("stretch"), F.exists("log", resets).alias("reset"), _last_role(F.col("log")).alias("role"), F.array_join(F.transform(texts, lambda e: e.text), "").alias("text"))
    folds = logs.select("conv_id", "message", F.get("log.seq", F.lit(0)).alias("seq"), part.alias("part"))
    parts = folds.groupBy("conv_id", "message").agg(F.min("seq").alias("at"), F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform(_after_reset(F.col("parts"), lambda p: p.reset, lambda p: F.lit(True)), lambda p: p.text), "")
    return parts.select("conv_id", "message", "at", F.coalesce(_last_role(F.col("parts")), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, message, at, role, text) -> conv_id, formatted, mask array<struct<chars, loss>>."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escaped(F.col("text"))
    tail = F.lit(END + "\n")
    loss = F.col("role") == "assistant"
    run = lambda chars, flag: F.struct(chars.cast("long").alias("chars"), flag.alias("loss"))
    turns = messages.select("conv_id", "at", "message", F.concat(head, body, tail).alias("out"), F.array(run(F.length(head), F.lit(False)), run(F.length(body), loss), run(F.length(tail), F.lit(False))).alias("runs"))
    blocks = turns.groupBy("conv_id", F.floor(F.col("at") / STRETCH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "message", "out", "runs"))).alias("ts"))
    blocks = blocks.select("conv_id", "block", F.array_join("ts.out", "").alias("out"), F.flatten("ts.runs").alias("runs"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "out", "runs"))).alias("bs"))
    return whole.select("conv_id", F.array_join("bs.out", "").alias("formatted"), F.flatten("bs.runs").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted -> conv_id, messages array<struct<role, text>>, formatted."""
    turns = F.split("formatted", r"\Q" + END + r"\E\n")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    # the role ends at the first newline without a backslash before it
    role = r"(?s)^\Q" + START + r"\E([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n.*"
    head = F.transform(turns, lambda t: F.struct(F.regexp_extract(t, role, 1).alias("role"), t.alias("turn")))
    messages = F.transform(head, lambda m: F.struct(unescaped(m.role).alias("role"), unescaped(F.substring(m.turn, F.length(m.role) + len(START) + 2, F.length(m.turn))).alias("text")))
    return formatted.select("conv_id", messages.alias("messages"), "formatted")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, n) with `message`, the number of the row in its conversation in the order of turn,
    role, text, and `base`, the sum of n over the rows before its pair; two neighbours in a block of turns are a pair.

    Blocks of BLOCK turns are numbered on their own; what stands before a block is a sum over blocks.
    """
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"k": F.row_number().over(inside) - 1, "sum": F.coalesce(F.sum("n").over(before), F.lit(0)), "prev": F.lag("n", 1, 0).over(inside)})
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("rows"), F.sum("n").alias("events"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("rows", "events")))
    joined = rows.join(blocks, rows.conv_id.eqNullSafe(blocks.c) & rows.block.eqNullSafe(blocks.b))
    second = F.col("k") % 2 == 1
    base = F.col("events_before") + F.col("sum") - F.when(second, F.col("prev")).otherwise(0)
    return joined.select("conv_id", "role", "text", (F.col("rows_before") + F.col("k")).alias("message"), base.alias("base"), second.cast("long").alias("second"))


def events_of(rows: DataFrame) -> DataFrame:
    """A conversation table as the log that would have led to it, with one sequence a conversation.

    Each row opens a message that streams in pieces of CHUNK code points. An assistant streams a first draft that is
    regenerated, a user a slip that is edited; of two neighbours, both streams are woven into each other.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = F.floor((F.length("text") + (CHUNK - 1)) / CHUNK).cast("int")
    before = F.when(F.col("role") == "assistant", 2).when((F.col("role") == "user") & (F.col("text") != ""), 1).otherwise(0)
    known = numbered(rows.withColumn("n", 1 + before + pieces))
    event = lambda kind, role, text: F.struct(kind.alias("kind"), role.cast("string").alias("role"), text.alias("text"))
    one = lambda kind, text: event(F.lit(kind), F.lit(None), text)
    start = F.substring("text", 1, 20)
    draft = F.when(before == 2, F.array(one("delta", start), one("regenerate", F.lit("")))).when(before == 1, F.array(one("delta", F.reverse(start)))).otherwise(F.expr("array()"))
    kind = lambda i: F.when((i == 1) & (F.col("role") == "user"), "edit").otherwise("delta")
    stream = F.when(pieces > 0, F.transform(F.sequence(F.lit(1), F.greatest(pieces, F.lit(1))), lambda i: event(kind(i), F.lit(None), F.substring(F.col("text"), (i - 1) * CHUNK + 1, F.lit(CHUNK))))).otherwise(F.expr("array()"))
    log = F.concat(F.array(event(F.lit("open"), F.col("role"), F.lit(""))), draft, stream)
    each = known.select("conv_id", "message", "base", "second", F.posexplode(log).alias("i", "e"))
    return each.select("conv_id", (2 * (F.col("base") + F.col("i")) + F.col("second")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """The figures of a formatted table, from its output alone."""
    read = read_back(formatted)
    all_turns = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m.role == "assistant"), lambda m: m.text), "")
    return read.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
