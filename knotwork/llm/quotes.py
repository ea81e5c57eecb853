"""Quotation linking for conversations, in DataFrame functions only.

A line's quote level is the number of ``>`` marks before its text. Runs of lines
of one level above 0 are quoted passages. Passages and messages are normalised
(lower case, white space squeezed) and hashed; a passage is joined to the latest
earlier message of its conversation whose body has that hash, or a line, run,
paragraph or as many consecutive lines of it, line for line. A passage of several lines that
stands nowhere as it is belongs to the earlier message that holds most of its lines,
if that is more than half (each counted once; of equal messages the later).
A message replies to the message that its shallowest linked passage comes from
(whole bodies before lines, then the later turn), or else to the one before it.
Conversations are built in reply order: (conv_id, parent_turn, turn) puts a parent
before its replies and replies to one message together; quoted lines are gone, and
role marks inside bodies are broken up by a blank. A long conversation is given in
parts of a bounded number of messages.

The first join is a union sorted by (conversation, hash, turn) with a running maximum
over range partitions, so a passage quoted a thousand times makes no thousand squared
pairs, and no task holds all rows of one hash. Runs of lines are found line by line, by
hashes of 1, 2, 4 … lines, so a long message costs a row a line and a row for each
passage length that begins there, not a text for each. Turns are numbered over range
partitions, so one conversation may hold a third of all rows.
Messages are known by 128 bits of hash of all they hold.

Defined cases: a null text is an empty message; a null role counts as ``user``;
a message without an earlier one has parent_turn -1; a null turn comes first and
nothing replies to it; rows that repeat (conv_id, turn) are one turn's messages,
linked each (equal rows alike); a null conv_id is a conversation of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm.common import written
from knotwork.operators.order import numbered

#: Marks kept out of texts before they delimit runs and levels.
RUN, LEVEL = "\u0001", "\u0002"
#: Messages of one part of a conversation.
PART_MESSAGES = 256
_QUOTE = r"^((?:\s*>)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def line_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), r"[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, _QUOTE + " ?", "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (no quoted lines), passages (level, text) and free (the unquoted runs) of each message."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), RUN + LEVEL + "\r", "")
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.split(text, "\n").alias("lines")
    )
    rows = rows.withColumn("levels", F.transform("lines", line_level))
    # a run begins where the level changes; it carries its level before its lines (no lambda
    # refers to a whole column: a filter pushed below would compute that once a line)
    shifted = F.concat(F.array(F.lit(-1)), F.slice("levels", 1, F.greatest(F.size("levels") - 1, F.lit(0))))
    joined = F.array_join(
        F.transform(
            F.arrays_zip("lines", "levels", shifted.alias("before")),
            lambda x, i: F.concat(
                F.when(i == 0, F.concat(x["levels"].cast("string"), F.lit(LEVEL)))
                .when(x["levels"] != x["before"], F.concat(F.lit(RUN), x["levels"].cast("string"), F.lit(LEVEL)))
                .otherwise(F.lit("\n")),
                F.when(x["levels"] > 0, unquoted(x["lines"])).otherwise(x["lines"]),
            ),
        ),
        "",
    )
    runs = F.transform(F.split(joined, RUN), lambda r: F.struct(F.substring_index(r, LEVEL, 1).cast("int").alias("level"), F.substring_index(r, LEVEL, -1).alias("text")))
    rows = rows.withColumn("runs", runs)
    free = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"])
    return rows.select("conv_id", "turn", "role", F.trim(F.array_join(free, "\n")).alias("body"), F.filter("runs", lambda r: r["level"] > 0).alias("passages"), free.alias("free"))


def hashed(text: Column) -> Column:
    return F.md5(normalised(text))


def filled(text: Column) -> Column:
    """The normalised lines of a text without the blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def blocks(runs: Column) -> Column:
    """Unquoted runs and their paragraphs, normalised."""
    paragraphs = F.flatten(F.transform(runs, lambda r: F.split(r, r"\n[\x20\x09-\x0D]*\n")))
    return F.filter(F.transform(F.concat(runs, paragraphs), normalised), lambda x: x != "")


def doubled(lines: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """``h``: for each line (keys, i, hash) the hashes of the 1, 2, 4 … lines that begin with it; null beyond the end."""
    w = W.partitionBy(*keys).orderBy("i")
    for k in range(levels + 1):
        own = F.col("hash") if k == 0 else F.md5(F.concat(F.col(f"_h{k - 1}"), F.lead(f"_h{k - 1}", 1 << (k - 1)).over(w)))
        lines = lines.withColumn(f"_h{k}", own)
    return lines.withColumn("h", F.array(*[f"_h{k}" for k in range(levels + 1)])).drop("hash", *[f"_h{k}" for k in range(levels + 1)])


def level_of(k: Column) -> Column:
    """The largest power of two in a number of lines, as an exponent."""
    return F.length(F.conv(k.cast("string"), 10, 2)) - 1


def power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), level_of(k).cast("int"))


def run_hash(k: Column, first: Column, last: Column) -> Column:
    """Of k lines: known by the hashes of its first and its last so many, a power of two that covers more than half."""
    return F.md5(F.concat_ws("|", k.cast("string"), first, last))


def asked_runs(asked: DataFrame, levels: int) -> DataFrame:
    """(row, at, conv_id, turn, k, first line, hash of the run) of passages of several lines."""
    each = asked.where(F.size("lines") > 1).select("row", "at", "conv_id", "turn", F.size("lines").alias("k"), F.posexplode(F.transform("lines", F.md5)).alias("i", "hash"))
    rows = doubled(each.withColumn("line", F.col("hash")), ["row", "at"], levels)
    own = F.element_at("h", level_of(F.col("k")) + 1)
    ends = rows.where((F.col("i") == 0) | (F.col("i") == F.col("k") - power(F.col("k"))))
    # a run of a power of two has its first and last in one row
    both = ends.groupBy("row", "at", "conv_id", "turn", "k").agg(F.min_by("line", "i").alias("line"), F.min_by(own, "i").alias("first"), F.max_by(own, "i").alias("last"))
    return both.select("row", "at", "conv_id", "turn", "k", "line", run_hash(F.col("k"), F.col("first"), F.col("last")).alias("hash"))


def offered_runs(quoted: DataFrame, runs: DataFrame, levels: int) -> DataFrame:
    """(conv_id, turn, hash) of runs of lines that begin like a passage of their conversation and are as long.

    Lines are rows, so a message of any number of lines is spread; each start costs a
    row for each length of the passages that begin with its line, whatever the length.
    """
    message = F.md5(F.to_json(F.struct("conv_id", "turn", "body"), {"ignoreNullFields": "false"}))
    each = quoted.select("conv_id", "turn", "body", message.alias("m")).dropDuplicates(["m"]).select("conv_id", "turn", "m", F.posexplode(F.transform(filled(F.col("body")), F.md5)).alias("i", "hash"))
    lines = written(doubled(each.withColumn("line", F.col("hash")), ["m"], levels), "lines")
    begun = runs.select(F.col("conv_id").alias("_c"), F.col("line").alias("_l"), "k").distinct()
    starts = lines.join(begun, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("line") == F.col("_l")))
    starts = starts.select("conv_id", "turn", "m", "k", F.element_at("h", level_of(F.col("k")) + 1).alias("first"), (F.col("i") + F.col("k") - power(F.col("k"))).alias("i")).where("first IS NOT NULL")
    ends = starts.join(lines.select("m", "i", "h"), ["m", "i"]).withColumn("last", F.element_at("h", level_of(F.col("k")) + 1)).where("last IS NOT NULL")
    return ends.select("conv_id", "turn", run_hash(F.col("k"), F.col("first"), F.col("last")).alias("hash")).distinct()


def earlier_max(rows: DataFrame, value: str) -> DataFrame:
    """Rows (conv_id, hash, turn, …) with ``source``: the largest value of the rows of their conversation and hash whose turn is smaller.

    Rows are dealt by ranges of (conversation, hash, turn), so a hash that all messages
    share is spread over partitions too. What earlier partitions hold of a key is added
    from one row for each partition and key that has several: at most two a partition.
    """
    ranged = written(rows.repartitionByRange("conv_id", "hash", "turn").withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part", "conv_id", "hash").agg(F.max(value).alias("v"))
    wide = sums.groupBy("conv_id", "hash").agg(F.collect_list(F.struct("_part", "v")).alias("p")).where(F.size("p") > 1)  # a row a partition
    before = F.transform("p", lambda x: F.struct(x["_part"].alias("part"), F.array_max(F.transform(F.filter("p", lambda y: y["_part"] < x["_part"]), lambda y: y["v"])).alias("v")))
    carried = wide.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h"), F.explode(before).alias("b")).select("_c", "_h", F.col("b.part").alias("_p"), F.col("b.v").alias("_v"))
    earlier = W.partitionBy("_part", "conv_id", "hash").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    own = ranged.withColumn("source", F.max(value).over(earlier))
    met = own.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("_part") == F.col("_p")), "left")
    return met.withColumn("source", F.greatest("source", "_v")).drop("_part", "_c", "_h", "_p", "_v")


def most_held(left: DataFrame, held: DataFrame) -> DataFrame:
    """(row, at, turn): the earlier message that holds most lines of a passage, and more than half of them; of equal ones the later.

    ``left``: conv_id, turn, row, at, lines (hashes); ``held``: conv_id, source, hash. Only
    lines that are asked for count, so messages that hold the same of them are one set,
    and passages of the same lines one question: a line that all messages hold makes a
    pair of one set and one question. A set with more than half of m lines holds one of
    any m - m / 2 of them: only the lines that the fewest sets hold make candidates. The
    latest earlier message of a set comes from a running maximum over turns.
    """
    joined = lambda a: F.md5(F.array_join(a, "|"))
    asks = written(left.withColumn("lines", F.array_sort("lines")).withColumn("ask", joined(F.col("lines"))), "asks")
    needed = asks.select(F.col("conv_id").alias("_c"), F.explode("lines").alias("_h")).distinct()
    known = held.join(needed, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
    sets = known.groupBy("conv_id", "source").agg(F.array_sort(F.collect_set("hash")).alias("all"))  # of one message
    sets = written(sets.withColumn("set", joined(F.col("all"))), "sets")
    kinds = sets.select("conv_id", "set", "all").dropDuplicates(["conv_id", "set"])
    holds = kinds.select("conv_id", "set", F.explode("all").alias("hash"))
    count = holds.groupBy(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).agg(F.count("*").alias("n"))
    each = asks.select("conv_id", "ask", "lines").dropDuplicates(["conv_id", "ask"]).select("conv_id", "ask", F.size("lines").alias("m"), F.explode("lines").alias("hash"))
    numbered_lines = each.join(count, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left").drop("_c", "_h")
    rank = F.row_number().over(W.partitionBy("conv_id", "ask").orderBy(F.coalesce("n", F.lit(0)), "hash"))
    rare = numbered_lines.withColumn("_k", rank).where(F.col("n").isNotNull() & (F.col("_k") <= F.ceil(F.col("m") / 2))).select("conv_id", "ask", "hash")
    named = holds.withColumnsRenamed({"conv_id": "_c", "hash": "_h"})
    met = rare.join(named, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h"))).select("conv_id", "ask", "set").distinct()
    a = asks.select(F.col("conv_id").alias("_c"), F.col("ask").alias("_a"), "lines").dropDuplicates(["_c", "_a"])
    s = kinds.withColumnsRenamed({"conv_id": "_d", "set": "_s"})
    counted = met.join(a, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("ask") == F.col("_a"))).join(s, F.col("conv_id").eqNullSafe(F.col("_d")) & (F.col("set") == F.col("_s")))
    counted = counted.withColumn("n", F.size(F.array_intersect("lines", "all"))).where(F.col("n") * 2 > F.size("lines")).select(F.col("conv_id").alias("_c"), F.col("ask").alias("_a"), "set", "n")
    asking = asks.join(counted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("ask") == F.col("_a"))).select("conv_id", F.col("set").alias("hash"), "turn", "row", "at", "n", F.lit(None).cast("long").alias("value"))
    turns = sets.select("conv_id", F.col("set").alias("hash"), F.col("source").alias("turn"), F.lit(None).cast("string").alias("row"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"), F.col("source").alias("value"))
    found = earlier_max(asking.unionByName(turns), "value").where("row IS NOT NULL AND source IS NOT NULL")
    return found.groupBy("row", "at").agg(F.max(F.struct("n", "source")).alias("best")).select("row", "at", F.col("best.source").alias("turn"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, position (from 1 in its conversation), n_passages, n_linked, body, chat."""
    # equal rows share their key and their links
    key = F.md5(F.to_json(F.struct("conv_id", "turn", "role", "body", "passages"), {"ignoreNullFields": "false"}))
    rows = written(parsed(messages).withColumn("row", key), "messages")
    quoting = rows.where(F.size("passages") > 0)
    asked = quoting.select("conv_id", "turn", "row", F.posexplode("passages").alias("at", "p")).select("conv_id", "turn", "row", "at", F.col("p.level").alias("level"), F.md5(normalised(F.col("p.text"))).alias("hash"), filled(F.col("p.text")).alias("lines"))
    asked = written(asked.dropDuplicates(["row", "at"]), "passages")
    # what can be quoted, in conversations that quote: whole bodies (kind 1); lines, runs, paragraphs and as many consecutive lines as a passage has (kind 0)
    asking = asked.select(F.col("conv_id").alias("_c")).distinct()
    quoted = rows.join(asking, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").where((F.col("body") != "") & F.col("turn").isNotNull())
    lines = filled(F.col("body"))
    parts = F.array_distinct(F.concat(lines, blocks(F.col("free"))))
    offered = F.concat(F.array(F.struct(F.lit(1).alias("whole"), hashed(F.col("body")).alias("hash"))), F.transform(parts, lambda x: F.struct(F.lit(0).alias("whole"), F.md5(x).alias("hash"))))
    longest = asked.agg(F.max(F.size("lines"))).first()[0] or 1
    runs = written(asked_runs(asked, longest.bit_length() - 1), "runs")
    index = quoted.select("conv_id", "turn", F.explode(offered).alias("o")).select("conv_id", "o.hash", "turn", "o.whole").unionByName(offered_runs(quoted, runs, longest.bit_length() - 1).withColumn("whole", F.lit(0)))
    index = index.select("conv_id", "hash", "turn", F.lit(None).cast("string").alias("row"), F.lit(None).cast("int").alias("at"), F.struct("whole", "turn").alias("value"))
    named = asked.select("conv_id", "hash", "turn", "row", "at").unionByName(runs.select("conv_id", "hash", "turn", "row", "at")).withColumn("value", F.lit(None).cast(index.schema["value"].dataType))
    sources = earlier_max(index.unionByName(named), "value").where("row IS NOT NULL").groupBy("row", "at").agg(F.max("source").alias("source"))
    found = written(asked.drop("hash").join(sources, ["row", "at"]), "found")
    left = found.where(F.col("source").isNull() & (F.size("lines") > 1)).withColumn("lines", F.array_distinct(F.transform("lines", F.md5)))
    held = quoted.select("conv_id", F.col("turn").alias("source"), F.explode(F.transform(lines, F.md5)).alias("hash")).distinct()
    partly = most_held(left, held).select("row", "at", F.struct(F.lit(0).alias("whole"), "turn").alias("partly"))
    linked = found.join(partly, ["row", "at"], "left").withColumn("source", F.coalesce("source", "partly"))
    best = linked.groupBy("row").agg(F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), F.col("source.whole"), F.col("source.turn").alias("turn")))).alias("best"), F.count_if(F.col("source").isNotNull()).alias("n_linked"))
    # a turn's previous one stands before it in the order of all turns
    turns = numbered(rows.select("conv_id", "turn").distinct(), F.asc("conv_id"), F.asc("turn"), name="n")
    last = turns.select((F.col("n") + 1).alias("n"), F.col("conv_id").alias("_c"), F.col("turn").alias("previous"))
    before = turns.join(last, "n", "left").withColumn("previous", F.when(F.col("conv_id").eqNullSafe(F.col("_c")), F.col("previous"))).drop("n", "_c")
    joined = rows.join(best, "row", "left").alias("m").join(before.alias("b"), F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("m.turn").eqNullSafe(F.col("b.turn")), "left")
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    chat = F.concat(F.lit("<|"), plain(F.col("m.role")), F.lit("|>\n"), plain(F.col("m.body")), F.lit("\n"))
    linked = joined.select(
        F.col("m.conv_id").alias("conv_id"), F.col("m.turn").alias("turn"), F.col("m.role").alias("role"),
        F.coalesce(F.col("best.turn"), F.col("b.previous"), F.lit(-1).cast("long")).alias("parent_turn"),
        F.size("m.passages").cast("long").alias("n_passages"), F.coalesce(F.col("n_linked"), F.lit(0).cast("long")).alias("n_linked"),
        F.col("m.body").alias("body"), chat.alias("chat"),
    )
    placed = numbered(linked, *[F.asc(c) for c in ("conv_id", "parent_turn", "turn", "role", "body")], name="n")
    first = placed.groupBy(F.col("conv_id").alias("_c")).agg((F.min("n") - 1).alias("_before"))
    own = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")))
    return own.select("conv_id", "turn", "role", "parent_turn", (F.col("n") - F.col("_before")).cast("long").alias("position"), "n_passages", "n_linked", "body", "chat")


def conversations(linked: DataFrame, most: int = PART_MESSAGES) -> DataFrame:
    """The linked messages as conversations: conv_id, part (from 0), n_messages, n_passages, n_linked, replies ("turn<parent", in order) and text; a part holds ``most`` messages at most."""
    part = F.floor((F.col("position") - 1) / most).cast("long").alias("part")
    reply = F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit("<"), F.col("parent_turn").cast("string"))
    rows = linked.groupBy("conv_id", part).agg(
        F.count("*").alias("n_messages"), F.sum("n_passages").alias("n_passages"), F.sum("n_linked").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("position", reply.alias("reply"), "chat"))).alias("m"),
    )
    return rows.select("conv_id", "part", "n_messages", "n_passages", "n_linked", F.array_join(F.transform("m", lambda x: x["reply"]), ",").alias("replies"), F.array_join(F.transform("m", lambda x: x["chat"]), "").alias("text"))
