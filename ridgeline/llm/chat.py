r"""Chat formatting: reply trees, branches ranked by score, and a template that can be read back. DataFrame functions only.

``linked`` makes a table of turns into trees (each row answers the one before). ``best_paths`` enumerates root-to-leaf paths by iterative self-joins of pointers that
double: after k joins a node knows its ancestor 2 ** k steps up, the number of nodes passed and their scores' sum. The best leaves
of each tree are chosen from these sums, and only their paths are walked, again by doubling: log2(depth) joins each way, on rows of ids without texts.

A turn is formatted as ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash is doubled and each control string gets a backslash after
its first character. Doubling makes all runs of backslashes even, so a single one is always the template's. Loss
spans are byte offsets into the formatted text (UTF-8).

Defined results: null texts and roles are empty; equal turns are ordered by role and text; a null tree id is a tree of its own; a parent that
isn't in the table makes its child a root; nodes that lead into a cycle have no root and go; a node id that repeats in a tree counts once (its least role and text);
ties between branches go to the longer one, then to the smaller leaf id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that texts may not hold as they are.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for s in CONTROLS:
        c = F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def linked(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes tree, node, parent, role, text, score: each row answers the row before it in its conversation."""
    rows = turns.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch (1 is the best), position (0 is the root), role, text for the ``branches`` best leaves of each tree."""
    key = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("n"))
    nodes = nodes.withColumn("key", key).groupBy("key", "node").agg(F.first("tree").alias("tree"), F.min(F.struct("role", "text", "parent", "score")).alias("r")).select("key", "node", "tree", "r.*")
    nodes = materialize(nodes)
    ids = nodes.select("key", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    there = ids.select("key", F.col("node").alias("up"), F.lit(True).alias("there"))
    level = ids.join(there, ["key", "up"], "left").select("key", "node", F.when(F.col("there"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("passed"), "total")
    level = materialize(level)
    inner = level.where("up is not null").select("key", F.col("up").alias("node")).distinct()
    leaves = level.join(inner, ["key", "node"], "left_anti").select("key", "node")
    # levels[k] tells of each node that has one its ancestor 2 ** k steps up; a node that has reached its root goes into ended, once
    ended, levels, longest = [level.where("up is null")], [], max(1, level.count()).bit_length()
    while len(levels) <= longest and not (going := level.where("up is not null")).isEmpty():
        levels.append(level)
        far = reduce(DataFrame.unionAll, [going, *ended]).select("key", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("passed").alias("passed2"), F.col("total").alias("total2"))
        level = materialize(going.join(far, ["key", "up"]).select("key", "node", F.col("up2").alias("up"), (F.col("passed") + F.col("passed2")).alias("passed"), (F.col("total") + F.col("total2")).alias("total")))
        ended.append(level.where("up is null"))
    rooted = reduce(DataFrame.unionAll, ended)
    rank = Window.partitionBy("key").orderBy(F.desc("total"), F.desc("passed"), "node")
    chosen = leaves.join(rooted, ["key", "node"]).withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = chosen.select("key", "branch", "node")
    path = materialize(path)
    for step in levels:
        up = step.where("up is not null").select("key", "node", "up")
        path = materialize(path.unionAll(path.join(up, ["key", "node"]).select("key", "branch", F.col("up").alias("node"))))
    depth = rooted.select("key", "node", (F.col("passed") - 1).alias("position"))
    out = path.join(depth, ["key", "node"]).join(nodes.select("key", "node", "tree", "role", "text"), ["key", "node"])
    out = materialize(out.select("tree", "branch", "position", "role", "text"))
    for x in levels:
        drop_scratch(x)
    return out


def formatted(paths: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """tree, branch, formatted, loss_spans: one row for each path. A span is the first byte (from 0) and the length in bytes."""
    rows = paths.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))).withColumn("body", escape(F.col("text")))
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    before = Window.partitionBy("tree", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.octet_length("head")).withColumn("len", F.octet_length("body"))
    turn = F.struct("position", F.concat("head", "body", F.lit(END)).alias("turn"), F.col("at").cast("int").alias("at"), "len", (F.col("role") == loss_role).alias("loss"))
    out = rows.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["at"].alias("at"), t["len"].alias("len")))
    return out.select("tree", "branch", F.array_join(F.col("turns.turn"), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rows: DataFrame) -> DataFrame:
    """rows of ``formatted`` with turns (role and text of each) and loss_texts, from the formatted text and the spans alone."""
    parts = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: F.contains(p, F.lit(TEXT)))  # all but what stands before the first turn

    def turn(p: Column) -> Column:
        return F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"))

    raw = F.col("formatted").cast("binary")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(raw, s["at"] + 1, s["len"]).cast("string")))
    return rows.withColumn("turns", F.transform(parts, turn)).withColumn("loss_texts", masked)


def chat_report(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    kinds = dict(conversations.dtypes)
    own = conversations.select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = read_back(formatted(best_paths(linked(own.unionByName(extra)))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_sql() -> str:
    """The report in DuckDB's SQL, straight from the turns."""
    def escaped(c: str) -> str:
        c = rf"replace({c}, '\', '\\')"
        for s in CONTROLS:
            c = rf"replace({c}, '{s}', '{s[0]}\{s[1:]}')"
        return c

    marks = len(TURN) + len(TEXT) + len(END)
    order = "order by turn, role, text"
    return f"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), a as (
            select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) as whole,
                coalesce(string_agg(text, '' {order}) filter (where role = '{LOSS_ROLE}'), '') as loss,
                sum({marks} + length({escaped("role")}) + length({escaped("text")})) as formatted_chars
            from t group by conv_id
        )
        select conv_id, cast(n_turns as bigint) as n_turns, sha256(whole) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
            sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
        from a"""
