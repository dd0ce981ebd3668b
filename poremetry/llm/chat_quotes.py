"""Chat formatting: quotation linking between the messages of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.operators.contract import smallest_reachable
from poremetry.workspace import materialize

PREFIX = r"^((?:[ \t]*>)*)[ \t]?"  # quote marks at the start of a line
WROTE = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[^\n]*:[ \t]*$"  # a line that announces a quotation
SENTENCE = r"(?<=[.!?…])\s+|(?<=[。！？])"  # between two sentences of a paragraph
BLOCK = 256  # turns of one conversation that are searched together


def _lines(text: Column) -> Column:
    """The lines of a message as (level, raw): the number of quote marks before a line, and the line as it is."""
    def parse(line: Column) -> Column:
        marks = F.regexp_replace(F.regexp_extract(line, PREFIX, 1), "[^>]", "")
        return F.struct(F.length(marks).alias("level"), line.alias("raw"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), parse)


def normalised(line: Column) -> Column:
    """What makes two passages the same: words without case and punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _level(i: Column) -> Column:
    """Quote level of line ``i``; outside the message there is none."""
    return F.coalesce(F.get("lines", i)["level"], F.lit(0))


def _body(i: Column) -> Column:
    return F.regexp_replace(F.get("lines", i)["raw"], PREFIX, "")


def _spans(starts_at, ends_at) -> Column:
    """Spans (s, e) of line numbers, both included, from conditions on their first and last line."""
    index = F.sequence(F.lit(0), F.size("lines") - 1)
    return F.zip_with(F.filter(index, starts_at), F.filter(index, ends_at), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def _blocks() -> Column:
    """Maximal spans of quoted lines."""
    quoted = lambda i: _level(i) > 0
    return _spans(lambda i: quoted(i) & ((i == 0) | ~quoted(i - 1)), lambda i: quoted(i) & ~quoted(i + 1))


def _paragraphs() -> Column:
    """Maximal spans of lines with words that have one quote level."""
    words = lambda i: F.coalesce(F.get("lines", i)["raw"], F.lit("")).rlike(r"[\p{L}\p{N}]")
    apart = lambda i, j: (_level(i) != _level(j)) | ~words(j)
    return _spans(lambda i: words(i) & ((i == 0) | apart(i, i - 1)), lambda i: words(i) & ((i == F.size("lines") - 1) | apart(i, i + 1)))


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written table of messages: (row_id, conv_id, turn, role, lines, blocks, paragraphs)."""
    split = messages.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.col(role).alias("role"), _lines(F.col(text)).alias("lines"))
    return materialize(split.withColumn("blocks", _blocks()).withColumn("paragraphs", _paragraphs()))


def _passages(parsed: DataFrame, quoted: bool) -> DataFrame:
    """(row_id, conv_id, turn, level, at, h): hashed passages, each once per paragraph; either quoted or the message's own.

    A passage is a line or a sentence. Sentences are cut from the joined lines of a paragraph, so they do not depend on where lines were wrapped;
    lines count too, since lists and greetings end without a mark. ``at`` is the first line of the paragraph.
    """
    level = _level(F.col("p.s"))
    rows = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("row_id", "conv_id", "turn", "lines", F.explode("paragraphs").alias("p"))
    rows = rows.where(level > 0 if quoted else level == 0).select(
        "row_id", "conv_id", "turn", level.alias("level"), F.col("p.s").alias("at"),
        F.transform(F.sequence("p.s", "p.e"), _body).alias("bodies"))
    pieces = F.concat(F.col("bodies"), F.split(F.array_join("bodies", " "), SENTENCE))
    texts = F.array_distinct(F.filter(F.transform(pieces, normalised), lambda t: t != ""))
    return rows.select("row_id", "conv_id", "turn", "level", "at", F.explode(texts).alias("t")).withColumn("h", F.sha2("t", 256)).drop("t")


def link(parsed: DataFrame) -> DataFrame:
    """(row_id, reply_to, n_linked, found_at): the earlier turn that a message quotes, the number of quoted passages that were found, and
    the first lines of their paragraphs.

    Every quoted passage is looked up among the passages that earlier messages of its conversation wrote themselves; the latest such
    message wins. The message replies to the turn with most of the passages at its lowest quote level; ties go to the later turn.
    Lookup is an ordered search per (conversation, passage, block of turns), with the last turn of earlier blocks
    carried over, so neither a busy conversation nor a passage that many messages hold is paired with itself.
    """
    key = ["conv_id", "h"]
    quotes = materialize(_passages(parsed, True))
    block = F.floor(F.col("turn") / BLOCK)
    asked = quotes.select(*key).distinct()
    own = materialize(_passages(parsed, False).join(asked, key, "left_semi").select(*key, "turn").distinct())
    ends = own.groupBy(*key, block.alias("block")).agg(F.max("turn").alias("last"))
    marks = ends.select(*key, "block", "last").unionByName(
        quotes.select(*key, block.alias("block"), F.lit(None).cast(own.schema["turn"].dataType).alias("last")).distinct())
    marks = marks.groupBy(*key, "block").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(marks.select(*key, "block", F.max("last").over(earlier).alias("before")))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("row_id", "bigint"), ("level", "int"), ("at", "int"))]
    events = own.select(*key, "turn", *nothing).unionByName(quotes.select(*key, "turn", "row_id", "level", "at"))
    inside = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("block", block).select(
        "*", F.max(F.when(F.col("row_id").isNull(), F.col("turn"))).over(inside).alias("near")).where("row_id IS NOT NULL")
    target = found.join(carried, [*key, "block"], "left").select("row_id", "level", "at", F.coalesce("near", "before").alias("target"))
    counted = target.where("target IS NOT NULL").groupBy("row_id", "level", "target").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("at").alias("places"))
    return counted.groupBy("row_id").agg(
        F.min(F.struct("level", -F.col("n"), -F.col("target"), "target"))["target"].alias("reply_to"), F.sum("n").alias("n_linked"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("found_at"))


def reply_order(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, place) for the messages of reply trees (conv_id, turn, parent): the place in depth-first order, replies by turn.

    The tour that enters and leaves every message is a linked list; places come from pointer doubling, in as many rounds as the
    logarithm of the longest tour. Every round is a join of unique keys and is written, so no tree is gathered anywhere.
    """
    key = ["conv_id", "parent"]
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    placed = parents.select(*key, "turn", block)
    near = Window.partitionBy(*key, "block").orderBy("turn")
    firsts = placed.groupBy(*key, "block").agg(F.min("turn").alias("first"))
    firsts = firsts.withColumn("beyond", F.lead("first").over(Window.partitionBy(*key).orderBy("block")))
    siblings = placed.withColumn("next", F.lead("turn").over(near)).join(firsts, [*key, "block"]).select(
        "conv_id", "turn", "parent", F.coalesce("next", "beyond").alias("sibling"))
    children = firsts.groupBy(*key).agg(F.min("first").alias("child")).withColumnRenamed("parent", "turn")
    nodes = parents.select("conv_id", "turn").unionByName(parents.select("conv_id", F.col("parent").alias("turn"))).distinct()
    nodes = nodes.join(siblings, ["conv_id", "turn"], "left").join(children, ["conv_id", "turn"], "left")
    step = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    enter = F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("turn"), True))
    leave = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).when(F.col("parent").isNotNull(), step(F.col("parent"), True))
    tour = nodes.select("conv_id", F.explode(F.array(
        F.struct(step(F.col("turn"), False).alias("here"), enter.alias("next"), F.lit(1).cast("bigint").alias("left")),
        F.struct(step(F.col("turn"), True).alias("here"), leave.alias("next"), F.lit(0).cast("bigint").alias("left")))).alias("e")).select("conv_id", "e.*")
    tour = materialize(tour, open=F.count("next"))
    while tour.metrics["open"]:
        onward = tour.select("conv_id", F.col("here").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        tour = materialize(tour.join(onward, ["conv_id", "next"], "left").select(
            "conv_id", "here", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), open=F.count("next"))
    # ``left`` counts the messages entered from here on; the root has all of its tree.
    return tour.where("NOT here.leaves").select("conv_id", F.col("here.turn").alias("turn"), "left")


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, reply_to, thread, place, max_level, n_quoted, n_linked, text, chat) for every message.

    ``reply_to`` is the turn whose words the message quotes; ``thread`` the first turn that is reached over such links, ``place`` the message's
    place in depth-first order of its thread, from 0. Sorted by (conv_id, thread, place) every message follows the one it replies to, replies to one
    message stand by turn, each with its own replies. Quotes link however they are wrapped, as whole lines or whole sentences.

    ``text`` is the message without quotations: blocks of quoted lines in which a passage was found, or that a line announces ("... wrote:"), with that line.
    Other lines that begin with ``>``, such as prompts, stay, and a message without quotations keeps its blank lines. ``chat`` is the formatted turn.

    Null texts are empty messages; rows with a null conversation or turn are formatted but never linked; of rows that share conversation and
    turn, each has its own ``reply_to``, and the smallest of them places all; an empty table gives an empty result; further columns are ignored.
    """
    parsed = parse(messages, conv, turn, role, text)
    linked = materialize(link(parsed).join(parsed.select("row_id", "conv_id", "turn"), "row_id"))
    parents = materialize(linked.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("parent")))
    threads = smallest_reachable(parents.select("conv_id", F.col("turn").alias("a"), F.col("parent").alias("b")), ("conv_id",))
    order = materialize(reply_order(parents).join(threads.select("conv_id", F.col("node").alias("turn"), "root"), ["conv_id", "turn"]))
    whole = order.where("turn = root").select("conv_id", "root", F.col("left").alias("of"))
    order = order.join(whole, ["conv_id", "root"]).select("conv_id", "turn", "root", (F.col("of") - F.col("left")).alias("place"))

    announced = lambda b: (b["s"] > 0) & F.coalesce(F.get("lines", b["s"] - 1)["raw"].rlike(WROTE), F.lit(False))
    found = lambda b: F.exists("found_at", lambda i: (i >= b["s"]) & (i <= b["e"]))
    cut = F.transform(F.filter("blocks", lambda b: announced(b) | found(b)), lambda b: F.struct(
        (b["s"] - announced(b).cast("int")).alias("s"), b["e"].alias("e")))
    gone = F.col("gone")

    def between(i):
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["e"] + 1)
        return F.slice("lines", start + 1, F.greatest(F.coalesce(F.get(gone, i)["s"], F.size("lines")) - start, F.lit(0)))

    kept = F.array_join(F.transform(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between)), lambda p: p["raw"]), "\n")
    plain = F.trim(F.when(F.size(gone) > 0, F.regexp_replace(kept, r"\n{3,}", "\n\n")).otherwise(kept), F.lit(" \n"))
    levels = F.transform("lines", lambda p: p["level"])
    joined = parsed.join(linked.select("row_id", "reply_to", "n_linked", "found_at"), "row_id", "left").withColumn(
        "found_at", F.coalesce("found_at", F.array().cast("array<int>"))).withColumn("gone", cut)
    facts = joined.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), plain.alias("text"),
        F.coalesce(F.array_max(levels), F.lit(0)).alias("max_level"), F.size(F.filter(levels, lambda v: v > 0)).alias("n_quoted"))
    return facts.join(order, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("thread"), F.coalesce("place", F.lit(0)).alias("place"),
        "max_level", "n_quoted", "n_linked", "text",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n<|end|>")).alias("chat"))
