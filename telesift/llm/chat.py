"""Chat formatting: reply trees, their best branches, and one formatted text for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: Strings that steer a chat model.  Inside texts they get a backslash after their first character; those that have
#: backslashes there already get one more, so that removing one gives the text back.
TAIL = r"(/?s>|/?INST\]|<SYS>>|</SYS>>|\|[^|<>]*\|>)"
ESCAPE, ESCAPED = rf"([<\[])(\\*){TAIL}", r"$1\\$2$3"
UNESCAPE, UNESCAPED = rf"([<\[])\\(\\*){TAIL}", r"$1$2$3"
HEAD = "<s>"
#: A turn that is not learnt: `[INST] role, line feed, text [/INST]`; one that is: `text</s>`.
TURN = r"(?s)\[INST\] ([^\n]*)\n(.*?) \[/INST\]|(.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def paths(messages: DataFrame, most_depth: int = 1 << 20) -> DataFrame:
    """(tree_id, leaf, node, up): every message on the way from each leaf to its root, `up` steps above the leaf.

    messages: tree_id, node, parent (null at a root).  Self-joins with doubling steps: the pairs found so far and the
    pointers 2^k steps up join to pairs twice as far, so a thread of n replies takes log2(n) rounds, and no row ever
    holds more than a pair of ids.  A parent that does not exist makes a root.  Replies in a circle have no leaf below
    them, or the walk stops with an error once it is deeper than most_depth.
    """
    m = messages.select("tree_id", "node", "parent")
    here = m.select(F.col("tree_id").alias("_t"), F.col("node").alias("_n"))
    known = m.where("parent is not null").join(here, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left_semi")
    step = cut(known.select("tree_id", "node", F.col("parent").alias("above")))
    parents = step.select(F.col("tree_id").alias("_t"), F.col("above").alias("_n"))
    leaves = m.join(parents, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    pairs = cut(leaves.select("tree_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    size = 1
    while not step.isEmpty():
        if size > most_depth:
            raise ValueError(f"replies are deeper than {most_depth} or run in a circle")
        s = step.select(F.col("tree_id").alias("_t"), F.col("node").alias("_n"), F.col("above").alias("_a"))
        same = F.col("tree_id").eqNullSafe(F.col("_t"))
        further = pairs.join(s, same & (F.col("node") == F.col("_n"))).select("tree_id", "leaf", F.col("_a").alias("node"), (F.col("up") + size).alias("up"))
        twice = step.join(s, same & (F.col("above") == F.col("_n"))).select("tree_id", "node", F.col("_a").alias("above"))
        old = pairs, step
        pairs, step = cut(pairs.unionByName(further)), cut(twice)
        for df in old:
            drop(df)
        size *= 2
    return pairs


def best_branches(pairs: DataFrame, messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, branch_score): the `top` branches of each tree by summed score, ties to the smaller leaf."""
    m = messages.select(F.col("tree_id").alias("_t"), F.col("node").alias("_n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("_s"))
    scored = pairs.join(m, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))).groupBy("tree_id", "leaf").agg(F.sum("_s").alias("branch_score"))
    w = Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def one_each(messages: DataFrame) -> DataFrame:
    """messages with one row for each (tree_id, node): of several the least by parent (null first), role, text, score."""
    rest = F.min(F.struct("parent", "role", "text", F.col("score").cast("double").alias("score"))).alias("_m")
    return messages.groupBy("tree_id", "node").agg(rest).select("tree_id", "node", "_m.*")


def format_branches(messages: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """One row per chosen branch: tree_id, leaf, rank, n_turns, formatted, loss: array of (start, length).

    messages: tree_id, node, parent, role, text, score; other columns are not read.  Null roles and texts are empty, very
    long ones stay whole, and an empty table gives no rows.  Repeated messages count once (see one_each()); unique says
    that there are none.  The loss mask covers the texts of assistant turns as they stand in `formatted`, in code points.
    """
    messages = messages if unique else cut(one_each(messages))
    pairs = paths(messages)
    chosen = best_branches(pairs, messages, top)
    steps = pairs.join(chosen.select(F.col("tree_id").alias("_ct"), F.col("leaf").alias("_cl"), "rank"), F.col("tree_id").eqNullSafe(F.col("_ct")) & (F.col("leaf") == F.col("_cl")))
    m = messages.select(F.col("tree_id").alias("_t"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = steps.join(m, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    learnt = F.col("_role") == "assistant"
    rows = rows.withColumn("_safe", escape(F.col("_text")))
    rows = rows.withColumn("_piece", F.when(learnt, F.concat("_safe", F.lit("</s>"))).otherwise(F.concat(F.lit("[INST] "), role_out(F.col("_role")), F.lit("\n"), F.col("_safe"), F.lit(" [/INST]"))))
    before = Window.partitionBy("tree_id", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.char_length("_piece")).over(before), F.lit(0)) + len(HEAD))
    turn = F.struct((-F.col("up")).alias("o"), F.col("_piece").alias("piece"), F.when(learnt, F.struct(F.col("_at").alias("start"), F.char_length("_safe").cast("long").alias("length"))).alias("loss"))
    made = rows.groupBy("tree_id", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return made.select("tree_id", "leaf", "rank", F.size("_turns").cast("long").alias("n_turns"), F.concat(F.lit(HEAD), F.array_join(F.col("_turns.piece"), "")).alias("formatted"), F.filter(F.col("_turns.loss"), lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with `turns`: array of (role, text) and `loss_text`, both taken from the formatted text alone."""
    body = F.substring("formatted", len(HEAD) + 1, 1 << 30)
    f = formatted.select("*", *[F.regexp_extract_all(body, F.lit(TURN), F.lit(i)).alias(n) for i, n in enumerate(("_whole", "_role", "_other", "_answer"))])
    turn = F.transform(F.arrays_zip("_whole", "_role", "_other", "_answer"), lambda t: F.when(F.startswith(t["_whole"], F.lit("[INST] ")), F.struct(role_in(t["_role"]).alias("role"), unescape(t["_other"]).alias("text"))).otherwise(F.struct(F.lit("assistant").alias("role"), unescape(t["_answer"]).alias("text"))))
    spans = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return f.select("*", turn.alias("turns"), F.array_join(spans, "").alias("loss_text")).drop("_whole", "_role", "_other", "_answer")


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of a table of turns: each turn answers the one before.

    Turns go by turn (null first), then role and text; rows equal in all of these follow each other.  A null conv_id
    is a conversation of its own.  A message scores 1 if it has a text, so that of two branches the fuller one wins.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    return c.select(F.col("conv_id").alias("tree_id"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.when(F.length("text") > 0, 1.0).otherwise(0.0).alias("score"))
