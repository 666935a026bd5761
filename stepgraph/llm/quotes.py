"""Quotation linking for conversations, in DataFrame functions only.

A line that starts with "> " marks is a quote of as many levels as it has marks.  Runs of lines of one level
without blank lines between them are passages.  Passages are normalised (lower case, white space collapsed)
and hashed; each hash of unquoted text belongs to the earliest message of its conversation that holds it, and
quoted passages are joined to those.  A passage no message holds as a whole is tried line by line.  A message
replies to the earlier message that most of its outermost linked quote comes from (then the later message).
Messages come out without quotes and attribution lines, in reply order: by conversation, thread root, turn.

Defined cases: null text is empty text; messages without a conversation id or a turn are linked to nothing,
are their own roots, and share one conversation of nulls; rows with equal conversation and turn have their
quotes and texts seen as one message's but keep their rows; blank quotes link nothing; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, ranked, table

#: Leading marks of a quoted line.
MARKS = r"^([ \t]{0,3}>)+"
#: A line that names whom the quote below it is from.
ATTRIBUTION = r"(wrote|writes|said|schrieb|escribió|a écrit)[^:\n]{0,80}:[ \t]*$"


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{A0}]+", " "))


def digest(text: Column) -> Column:
    return F.md5(text)


def unquoted(text: Column) -> Column:
    """The text without quoted lines and the attribution right above them; line ends around them trimmed if there were any."""
    lines = F.split(text, "\n", -1)

    def keep(line: Column, at: Column) -> Column:
        following = F.get(lines, at + 1)
        attribution = line.rlike(ATTRIBUTION) & F.coalesce(level(following) > 0, F.lit(False))
        return (level(line) == 0) & ~attribution

    return F.when(text.rlike(r"(?m)" + MARKS), F.trim(F.array_join(F.filter(lines, keep), "\n"), F.lit("\n "))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(_uid, _conv, _turn, level, hash, size, parts): parts holds the hashes and sizes of the lines of a longer passage."""
    lines = messages.select("_uid", "_conv", "_turn", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("level", level(F.col("_line"))).withColumn("_body", normal(F.regexp_replace("_line", MARKS, "")))
    order = Window.partitionBy("_uid").orderBy("_pos")  # within one text
    starts = (F.col("level") != F.lag("level", 1, -1).over(order)) | (F.lag("_body", 1, "").over(order) == "")
    lines = lines.withColumn("_run", F.sum(starts.cast("int")).over(order)).filter("_body <> ''")
    whole = lines.groupBy("_uid", "_conv", "_turn", "_run", "level").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_body"))), lambda x: x["_body"]).alias("_bodies")
    )
    joined = F.array_join("_bodies", " ")
    parts = F.when(F.size("_bodies") > 1, F.transform("_bodies", lambda x: F.struct(digest(x).alias("hash"), F.length(x).alias("size"))))
    return whole.select("_uid", "_conv", "_turn", "_run", "level", digest(joined).alias("hash"), F.length(joined).alias("size"), parts.alias("parts"))


def roots(parents: DataFrame) -> DataFrame:
    """(_conv, _turn, root, depth) of the messages that have a parent, by pointer doubling."""
    now = checkpoint(parents.select("_conv", "_turn", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = now.select("_conv", F.col("_turn").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"))
        then = checkpoint(now.join(up, ["_conv", "root"], "left"))
        done = then.filter("_next is not null").isEmpty()
        now = then.select("_conv", "_turn", F.coalesce("_next", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))
        if done:
            return now


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, quotes, linked, parent_turn, root_turn, depth, reply_index) for every message.

    text is without quotes; quotes counts quoted passages and linked those found in an earlier message;
    reply_index counts from 0 within the conversation: threads by the turn of their root, messages by turn.
    """
    uid = F.monotonically_increasing_id()
    base = checkpoint(  # read several times below: each message keeps its number
        messages.select(
            uid.alias("_uid"), F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text")
        )
    )
    quoting = base.filter(F.col("_text").rlike("(?m)" + MARKS) & F.col("_conv").isNotNull() & F.col("_turn").isNotNull())
    # Only conversations with a quote can hold a link; the others need no line of theirs looked at.
    talks = checkpoint(quoting.groupBy("_conv").agg(F.max("_turn").alias("_last")))
    found = checkpoint(passages(base.join(talks, "_conv").filter("_turn <= _last").drop("_last")))
    lines = F.explode("parts")
    own = found.filter("level = 0")
    held = own.select("_conv", "hash", "_turn").unionByName(own.select("_conv", lines.alias("p"), "_turn").select("_conv", F.col("p.hash"), "_turn"))
    # One row for each passage of a conversation, however often it is said.
    first = checkpoint(held.groupBy("_conv", "hash").agg(F.min("_turn").alias("said")))
    quoted = found.filter("level > 0")
    whole = checkpoint(
        quoted.join(first, ["_conv", "hash"], "left").withColumn("said", F.when(F.col("said") < F.col("_turn"), F.col("said")))
    )
    by_line = (
        whole.filter("said is null and parts is not null")
        .select("_uid", "_conv", "_turn", "_run", "level", lines.alias("p"))
        .select("_uid", "_conv", "_turn", "_run", "level", F.col("p.hash").alias("hash"), F.col("p.size").alias("size"))
        .join(first, ["_conv", "hash"])
        .filter("said < _turn")
    )
    columns = ["_uid", "_conv", "_turn", "_run", "level", "size", "said"]
    links = whole.filter("said is not null").select(columns).unionByName(by_line.select(columns))
    parents = (
        links.groupBy("_conv", "_turn", "said", "level")
        .agg(F.sum("size").alias("size"))
        .groupBy("_conv", "_turn")
        .agg(F.max_by("said", F.struct(-F.col("level"), F.col("size"), F.col("said"))).alias("parent"))
    )
    threads = checkpoint(parents)
    placed = checkpoint(roots(threads).join(threads, ["_conv", "_turn"]))
    tally = quoted.groupBy("_uid").agg(F.count(F.lit(1)).alias("quotes"))
    hits = links.groupBy("_uid").agg(F.countDistinct("_run").alias("linked"))
    rows = base.join(placed, ["_conv", "_turn"], "left").join(tally.join(hits, "_uid", "left"), "_uid", "left")
    rows = rows.withColumn("root", F.coalesce("root", "_turn")).withColumn("_talk", F.coalesce(F.col("_conv").cast("string"), F.lit("null")))
    place = ranked(rows.select("_uid", "_talk", "root", "_turn"), ["_talk"], ["root", "_turn", "_uid"])
    return rows.join(place.select("_uid", "_rank"), "_uid").select(
        F.col("_conv").alias(conv),
        F.col("_turn").alias(turn),
        F.col("_role").alias(role),
        unquoted(F.col("_text")).alias(text),
        F.coalesce("quotes", F.lit(0)).cast("long").alias("quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked"),
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("_rank").cast("long").alias("reply_index"),
    )


def op3_quotes(spark, sf_dir):
    return link_quotes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
