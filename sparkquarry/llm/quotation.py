"""Quotation linking: reply-ordered conversations without quotes.

DataFrame functions only.  Lines of a message carry quote marks; consecutive
lines of one level are a passage.  Passages are normalised, hashed and joined,
inside their conversation, to the hashes of runs of words that earlier turns
said themselves, whoever wrote them, however either is wrapped: whole lines, as many as there are, and
for passages of ``GRAM`` words or more any run, if no earlier turn has it as
whole lines.  A message replies to the author of the first passage of the
lowest level that is found in an earlier turn.  Messages are then ordered so
that replies follow what they answer, and numbered.

Scale.  Only messages with quote marks are taken apart line by line.  A run is
hashed only where a passage's first ``GRAM`` words stand, and only for the
lengths of such passages.  Hashes meet by salted grouping, so a line that
everybody quotes is no single task.
Reply trees are numbered by ranking their Euler tours: each turn is entered and
left once, every step knows the next, and doubling adds up what follows, in as
many rounds as the logarithm of the largest tree's turns, with one row for each
step whatever the depth.  Trees of a conversation are numbered through cells of
turns, so a conversation with a third of all rows takes many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, group_totals, id_out, spread_join, written

#: Up to three spaces may stand before the first mark.
MARKS = r"^\x20{0,3}>[>\x20]*"
#: A line that introduces a quotation: it ends so and stands right before a quoted line.
INTRO = r"(?i)(wrote|writes|schrieb|a écrit|escribió)\x20?:\s*$"
#: A shorter passage is found as whole lines alone.
GRAM = 5
#: Turns of a cell.
CELL = 256


def level(line: Column) -> Column:
    """Quote marks at a line's beginning."""
    return F.length(F.regexp_replace(F.regexp_extract(line, f"({MARKS})", 1), "[^>]", ""))


def normal(text: Column) -> Column:
    """Lower case, without outer white space, inner white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """conv, turn, m, at, level, passage of messages (conv, turn, m, text); level 0 is the message's own text."""
    lines = messages.select("conv", "turn", "m", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    by_message = Window.partitionBy("m").orderBy("at")
    lines = lines.withColumn("level", level(F.col("line")))
    lines = lines.withColumn("intro", (F.col("level") == 0) & F.col("line").rlike(INTRO) & (F.lead("level", 1, 0).over(by_message) > 0))
    lines = lines.filter("not intro").withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(by_message), F.lit(-1))).cast("int"))
    lines = lines.withColumn("part", F.sum("new").over(by_message))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("line", MARKS, "").alias("line")))), lambda x: x["line"]), "\n")
    return lines.groupBy("conv", "turn", "m", "part", "level").agg(F.min("at").alias("at"), text.alias("passage")).select("conv", "turn", "m", "at", "level", "passage")


def said_runs(spoken: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, turn, hash, whole of runs of words in messages (conv, turn, m, clean) that may be passages of ``quoted``; ``whole``: of whole lines."""
    lines = F.filter(F.transform(F.split("clean", r"\r?\n"), normal), lambda x: x != "")
    spoken = spoken.select("conv", "turn", "m", lines.alias("lines")).filter("size(lines) > 0").dropDuplicates(["m"])
    # fewer words than a gram: runs of whole lines, at most as many lines as words
    runs = F.flatten(F.transform("lines", lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM - 1), F.size("lines") - i)), lambda n: F.array_join(F.slice("lines", i + 1, n), " "))))
    short = F.array_distinct(F.filter(runs, lambda x: F.size(F.split(x, " ")) < GRAM))
    short = spoken.select("conv", "turn", F.explode(short).alias("text")).select("conv", "turn", F.sha2("text", 256).alias("hash"), F.lit(True).alias("whole"))
    # more: where the first words of a passage stand
    word = F.flatten(F.transform("lines", lambda x: F.transform(F.split(x, " "), lambda w, j: F.struct(w.alias("w"), (j == 0).alias("first")))))
    texts = spoken.select("conv", "turn", "m", word.alias("words")).filter(F.size("words") >= GRAM)
    gram = lambda words: F.xxhash64(F.array_join(words, " "))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: F.xxhash64(F.array_join(F.transform(F.slice("words", i + 1, GRAM), lambda x: x["w"]), " ")))
    here = texts.select("conv", "m", F.posexplode(grams).alias("pos", "gram")).withColumn("n", F.lit(None).cast("int"))
    asked = quoted.select("conv", F.split("text", " ").alias("q")).filter(F.size("q") >= GRAM)
    asked = asked.select("conv", F.lit(None).cast("string").alias("m"), F.lit(None).cast("int").alias("pos"), gram(F.slice("q", 1, GRAM)).alias("gram"), F.size("q").alias("n")).distinct()
    lengths = F.array_distinct(F.flatten(F.collect_list("_n")))
    met = group_totals(here.unionByName(asked), ["conv", "gram"], {"_n": F.collect_set("n")}, {"lengths": lengths}, F.concat_ws(",", "m", "pos", "n"), F.size("lengths") > 0)
    starts = met.filter("m is not null").groupBy("m").agg(F.collect_list(F.struct("pos", "lengths")).alias("starts"))
    run = lambda p, n: F.struct(
        F.sha2(F.array_join(F.transform(F.slice("words", p + 1, n), lambda x: x["w"]), " "), 256).alias("hash"),
        (F.get("words", p)["first"] & F.coalesce(F.get("words", p + n)["first"], F.lit(True))).alias("whole"),
    )
    fits = lambda x: F.filter(x["lengths"], lambda n: x["pos"] + n <= F.size("words"))
    found = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.transform(fits(x), lambda n: run(x["pos"], n)))))
    long = texts.join(starts, "m").select("conv", "turn", F.explode(found).alias("r")).select("conv", "turn", "r.hash", "r.whole")
    return short.unionByName(long)


def following(df: DataFrame, groups: tuple[str, ...], name: str) -> DataFrame:
    """Adds ``name``: the next greater turn of the group, found inside cells of turns and between them."""
    cells = df.withColumn("_cell", F.floor(F.col("turn") / CELL))
    firsts = cells.groupBy(*groups, "_cell").agg(F.min("turn").alias("_first"))
    after = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*groups).orderBy("_cell"))).drop("_first")
    inside = F.lead("turn").over(Window.partitionBy(*groups, "_cell").orderBy("turn"))
    return cells.withColumn("_inside", inside).join(after, [*groups, "_cell"]).withColumn(name, F.coalesce("_inside", "_next")).drop("_cell", "_inside", "_next")


def tree_places(turns: DataFrame) -> DataFrame:
    """conv, turn, root, behind: of every turn of a reply tree, its root and the rows from it to the tree's end; ``turns``: (conv, turn, w, up)."""
    replies = turns.filter("up is not null")
    nodes = replies.select("conv", "turn").unionByName(replies.select("conv", F.col("up").alias("turn"))).distinct().join(turns, ["conv", "turn"])
    child = replies.groupBy("conv", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    sibling = following(replies.select("conv", "up", "turn"), ("conv", "up"), "sibling").select("conv", "turn", "sibling")
    nodes = nodes.join(child, ["conv", "turn"], "left").join(sibling, ["conv", "turn"], "left")
    step = lambda turn, leaves: F.struct(turn.alias("turn"), leaves.alias("leaves"))
    yes, no = F.lit(True), F.lit(False)
    enter = nodes.select("conv", step(F.col("turn"), no).alias("at"), F.when(F.col("child").isNotNull(), step(F.col("child"), no)).otherwise(step(F.col("turn"), yes)).alias("to"), "w")
    leave = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), no)).when(F.col("up").isNotNull(), step(F.col("up"), yes))
    steps = enter.unionByName(nodes.select("conv", step(F.col("turn"), yes).alias("at"), leave.alias("to"), F.lit(0).cast("long").alias("w")))
    steps = written(steps.withColumn("root", F.when(F.col("to").isNull(), F.col("at.turn"))), "tour")
    while not steps.filter("to is not null").isEmpty():
        ahead = steps.select("conv", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("root").alias("_root"))
        # finished steps join nothing: with their null key a conversation's would all meet in one task
        joined = steps.filter("to is not null").join(ahead, ["conv", "to"], "left").select("conv", "at", F.col("_to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.coalesce("root", "_root").alias("root"))
        before, steps = steps, written(joined.unionByName(steps.filter("to is null").select(*joined.columns)), "tour")
        discard(before)
    return steps.filter("not at.leaves").select("conv", "at.turn", "root", F.col("w").alias("behind"))


def turn_places(turns: DataFrame) -> DataFrame:
    """conv, turn, first: the number of each turn's first row in reply order; ``turns``: (conv, turn, w, up)."""
    places = tree_places(turns) if not turns.filter("up is not null").isEmpty() else None
    roots = turns.filter("up is null").select("conv", "turn", F.col("w").alias("size"))
    if places is not None:
        sizes = places.filter("turn = root").select("conv", "turn", F.col("behind").alias("_size"))
        roots = roots.join(sizes, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("_size", "size").alias("size"))
    roots = roots.withColumn("cell", F.floor(F.col("turn") / CELL))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = roots.groupBy("conv", "cell").agg(F.sum("size").alias("n"))
    cells = cells.select("conv", "cell", F.coalesce(F.sum("n").over(past(Window.partitionBy("conv").orderBy("cell"))), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("size").over(past(Window.partitionBy("conv", "cell").orderBy("turn"))), F.lit(0))
    roots = roots.withColumn("inside", inside).join(cells, ["conv", "cell"]).select("conv", "turn", (F.col("offset") + F.col("inside")).alias("first"), "size")
    if places is None:
        return roots.select("conv", "turn", "first")
    # the root's place reaches the turns of its tree in cells of their own
    apart = places.filter("turn <> root").withColumn("cell", F.floor(F.col("turn") / CELL))
    above = apart.select("conv", "root", "cell").distinct().join(roots.withColumnRenamed("turn", "root"), ["conv", "root"])
    below = apart.join(above, ["conv", "root", "cell"]).select("conv", "turn", (F.col("first") + F.col("size") - F.col("behind")).alias("first"))
    return roots.select("conv", "turn", "first").unionByName(below)


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, n_quotes, n_linked, quote_depth, reply_to, position, clean_text; one row per input row.

    ``reply_to`` is the turn answered, null without a passage that is found.
    ``position`` numbers a conversation's rows from 0 in reply order.  Null
    texts are empty.  Null conversations are one conversation and null turns
    come first; both come out null.  Rows of one turn are ordered by role and
    text; equal rows get numbers of their own.  Empty tables give empty results.
    """
    lowest = F.lit(-(2**63))
    base = messages.select(
        F.coalesce(col(messages, conv_col).cast("long"), lowest).alias("conv"), F.coalesce(col(messages, turn_col).cast("long"), lowest).alias("turn"),
        col(messages, role_col).cast("string").alias("role"), F.coalesce(col(messages, text_col).cast("string"), F.lit("")).alias("text"),
    )
    base = base.withColumn("m", F.sha2(F.concat_ws("\x1f", "conv", "turn", F.coalesce("role", F.lit("")), "text"), 256))
    quoting = base.filter(F.col("text").rlike(f"(?m){MARKS}")).dropDuplicates(["m"])
    parts = written(passages(quoting), "passages")
    quoted = parts.filter("level > 0").select("conv", "turn", "m", "at", "level", normal(F.col("passage")).alias("text")).filter("text <> ''")
    own = parts.filter("level = 0").groupBy("m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "passage"))), lambda x: x["passage"]), "\n").alias("clean"))
    clean = base.join(own, "m", "left").withColumn("clean", F.when(F.col("text").rlike(f"(?m){MARKS}"), F.trim(F.coalesce("clean", F.lit("")))).otherwise(F.col("text")))
    # what each message says itself, in conversations where anybody quotes
    spoken = spread_join(clean, "conv", quoted.select("conv").distinct(), F.col("m"))
    said = written(said_runs(spoken, quoted), "said")
    null = [F.lit(None).cast(t).alias(n) for n, t in (("m", "string"), ("at", "int"), ("level", "int"))]
    both = said.select("conv", "hash", "turn", "whole", F.lit(0).alias("kind"), *null).unionByName(
        quoted.select("conv", F.sha2("text", 256).alias("hash"), "turn", F.lit(None).cast("boolean").alias("whole"), F.lit(1).alias("kind"), "m", "at", "level")
    )
    partial = {"_w": F.min(F.when(F.col("whole"), F.col("turn"))), "_t": F.min(F.when(F.col("kind") == 0, F.col("turn")))}
    met = group_totals(both, ["conv", "hash"], partial, {"lines": F.min("_w"), "first": F.min("_t")}, F.concat_ws(",", "turn", "m", "at"))
    earlier = lambda c: F.when(F.col(c) < F.col("turn"), F.col(c))
    found = met.filter("kind = 1").withColumn("to", F.coalesce(earlier("lines"), earlier("first")))
    links = found.groupBy("m").agg(
        F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"), F.max("level").alias("quote_depth"),
        F.min(F.when(F.col("to").isNotNull(), F.struct("level", "at", "to"))).alias("parent"),
    )
    rows = clean.join(links, "m", "left").select("conv", "turn", "role", "m", "clean", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), F.col("parent.to").alias("reply_to"))
    rows = written(rows, "messages")
    # a turn replies as its first replying message does
    turns = rows.groupBy("conv", "turn").agg(F.count("*").alias("w"), F.min("reply_to").alias("up"))
    places = turn_places(written(turns, "turns"))
    nth = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "m"))
    out = rows.withColumn("nth", nth).join(places, ["conv", "turn"])
    return out.select(
        id_out("conv").alias("conv_id"), id_out("turn").alias("turn"), "role", "n_quotes", "n_linked", "quote_depth", id_out("reply_to").alias("reply_to"),
        (F.col("first") + F.col("nth") - 1).alias("position"), F.col("clean").alias("clean_text"),
    )
