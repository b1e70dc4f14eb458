"""Operator 8, chat formatting: reply trees to one conversation each, built-in functions alone.

A tree's nodes point to their parents. Root-to-leaf paths come from iterative self-joins on the pointers:
round k joins every node with the node 2^k above it (pointer doubling), so a path of length n takes log2(n)
rounds, and no round carries texts. Leaves are ranked by the score of their whole branch, and each chosen
branch is formatted as one string.

Template: every turn is `<turn>role<body>text</turn>` and a line feed. Inside role and text a backslash
becomes `\\b` and `<` becomes `\\l`, so no control string can be part of a text, and reading back is exact.

Cases: a null text or role is empty; a null parent marks a root, as does one that doesn't exist (the rest of
a torn tree still comes out); rows of a conversation that tie on the turn are ordered by role, then text;
repeated rows are turns of their own; a null conversation id is a conversation like any other; texts of any length
are formatted whole; an empty table gives no conversation; columns beside those named are left out, whatever their
names. Of branches with equal scores the longer one comes first, then the one with the lesser leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>\n"
#: The conversation the query adds to the table: control strings inside the texts.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def branches(nodes: DataFrame, rounds_limit: int = 40) -> DataFrame:
    """nodes(tree, node, parent, score) -> (tree, node, depth, total, is_leaf): the root path of every node.

    tree and node are not null. After round k, `up` is the 2^k-th ancestor, and depth and total cover the
    nodes below it. Pointers that lead nowhere are roots. The loop ends when no pointer is left; parents in
    a circle would never end, and rounds_limit (paths of 2^40) makes that an error."""
    ids = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("known"))
    state = (
        nodes.withColumnRenamed("parent", "up")
        .join(ids, ["tree", "up"], "left")
        .select("tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    )
    state = materialize(state)
    parents = state.where("up IS NOT NULL").select("tree", F.col("up").alias("node"), F.lit(False).alias("leaf")).distinct()
    for _ in range(rounds_limit):
        # Nodes whose pointer has passed the root are done and stay out of the join.
        climbing = state.where("up IS NOT NULL")
        if climbing.limit(1).isEmpty():
            return state.join(parents, ["tree", "node"], "left").select("tree", "node", "depth", "total", F.coalesce("leaf", F.lit(True)).alias("is_leaf"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        climbed = climbing.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        state = materialize(state.where("up IS NULL").unionByName(climbed))
    raise ValueError("reply pointers form a circle")


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The per_tree best root-to-leaf paths of every tree: (tree, branch_rank, leaf, node, pos), pos from 0 at
    the root. Branches rank by mean score, the longer first among equals, then by leaf. Only chosen leaves are
    expanded, again by doubling: round k adds to every path the nodes 2^k above those it has."""
    ranked = (
        branches(nodes)
        .where("is_leaf")
        .withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "node")))
        .where(F.col("branch_rank") <= per_tree)
        .select("tree", "branch_rank", F.col("node").alias("leaf"), "depth")
    )
    paths = materialize(ranked.withColumn("node", F.col("leaf")).withColumn("pos", F.col("depth") - 1)).drop("depth")
    ids = nodes.select("tree", F.col("node").alias("up"))
    jump = materialize(nodes.select("tree", "node", F.col("parent").alias("up")).join(ids, ["tree", "up"], "left_semi").select("tree", "node", "up"))
    step = 1
    while not jump.limit(1).isEmpty():
        more = paths.join(jump, ["tree", "node"]).select("tree", "branch_rank", "leaf", F.col("up").alias("node"), (F.col("pos") - step).alias("pos"))
        paths = materialize(paths.unionByName(more))
        jump = materialize(jump.join(jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2")), ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")))
        step *= 2
    return paths


def format_turns(turns: Column) -> Column:
    """An ordered array<struct<role, text>> as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(CLOSE))), "")


def parse_turns(formatted: Column) -> Column:
    """format_turns() backwards: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, F.lit(CLOSE)), lambda x: x != "")
    head = len(OPEN)
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, BODY, 1), F.lit(head + 1), F.length(x))).alias("role"),
            unescape(F.substring_index(x, BODY, -1)).alias("text"),
        ),
    )


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Half-open code point ranges of the formatted string that count for the loss: the texts of role."""
    parts = F.filter(F.split(formatted, F.lit(CLOSE)), lambda x: x != "")
    mark = F.lit(OPEN + role + BODY)
    starts = F.aggregate(
        F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.startswith(mark).alias("on"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["n"] + len(CLOSE)).alias("at"),
            F.when(x["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + len(OPEN + role + BODY)).alias("s"), (a["at"] + x["n"]).alias("e"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return starts["spans"]


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply trees: each row answers the one before it. The key is
    a text, so that a null conv_id is a tree of its own."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id", "role", "text", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), F.row_number().over(w).cast("long").alias("node")
    )


def format_trees(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """nodes(tree, node, parent, score, role, text) -> (tree, branch_rank, formatted, loss_spans)."""
    paths = best_paths(nodes.select("tree", "node", "parent", "score"), per_tree)
    turns = (
        paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
        .groupBy("tree", "branch_rank")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
        .select("tree", "branch_rank", format_turns(F.col("turns")).alias("formatted"))
    )
    return turns.withColumn("loss_spans", loss_spans(F.col("formatted")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT stack(2, 0, 'user', 1, 'assistant') AS (turn, role)").select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("turn").cast("long"), "role", F.lit(PROBE_TEXT).alias("text")
    )
    nodes = conversation_nodes(rows.unionByName(probe))
    nodes = nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))
    made = format_trees(materialize(nodes.drop("conv_id")))
    back = made.select(F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), "formatted", "loss_spans", parse_turns(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["s"] + 1, s["e"] - s["s"]))), "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL_OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(role) + length(text)
           + length(role) - length(replace(replace(role, '\', ''), '<', ''))
           + length(text) - length(replace(replace(text, '\', ''), '<', '')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
