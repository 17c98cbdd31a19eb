"""Chat formatting of reply trees.

Iterative self-joins double the distance to an ancestor until every message knows its root, the length of its path and
the sum of the scores on it. Leaves are ranked by their path's score, and the same doubled links, applied once each,
enumerate all messages of the chosen paths. Each chosen path becomes one string with a loss mask over the assistant's
texts. The number of joins is logarithmic in the longest path. Only DataFrame functions run.

Inside roles and texts a backslash precedes every backslash and splits every control string, whichever template it
belongs to, so no text can end a turn; removing one backslash of each pair restores the text.

Defined results: a null role or text is an empty one; a message whose parent is null or absent is a root; messages on a
cycle have no root and are in no path; equal scores are ranked by the leaf's id; rows that repeat a message's id are
further messages there, in the order of role and text; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import drop, read, table

START, MIDDLE, STOP = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates: what follows the first character.
_CONTROLS = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROLS, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """messages: (conv, node, parent, score). (conv, leaf, rank, score, node, step) of the best branches of every conv.

    step is 0 at the root; branches None: all of them.
    """
    nodes = table(messages.groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.sum("score").alias("score")), "nodes")
    here = nodes.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    known = nodes.join(here, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left")
    state = table(known.select("conv", "node", F.col("p").alias("up"), F.col("score").cast("double").alias("score"), F.lit(1).cast("long").alias("length")), "links0")
    # level k holds the links to the 2^k-th ancestor, of the messages that have one; the others' paths are known by then
    levels, known_paths, open_rows = [state], state.where("up IS NULL"), state.where("up IS NOT NULL").count()
    while open_rows:
        live = levels[-1].where("up IS NOT NULL")
        above = known_paths.union(live).select(F.col("conv").alias("c"), F.col("node").alias("p"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("length").alias("l2"))
        joined = live.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("p")))
        levels.append(table(joined.select("conv", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("length") + F.col("l2")).alias("length")), f"links{len(levels)}"))
        known_paths = known_paths.union(levels[-1].where("up IS NULL"))
        now = levels[-1].where("up IS NOT NULL").count()
        if now == open_rows:  # what is left runs in circles: a path would have lost its end
            break
        open_rows = now
    parents = state.where("up IS NOT NULL").select(F.col("conv").alias("c"), F.col("up").alias("p")).distinct()
    leaves = known_paths.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    ranked = leaves.withColumn("rank", F.expr("row_number() OVER (PARTITION BY conv ORDER BY score DESC, node)"))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    paths = table(ranked.select("conv", F.col("node").alias("leaf"), "rank", "score", "node", (F.col("length") - 1).alias("step")), "paths")
    for k in range(len(levels) - 1, -1, -1):
        link = levels[k].where("up IS NOT NULL").select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        more = paths.join(link, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        grown = table(paths.union(more.select("conv", "leaf", "rank", paths["score"], F.col("up").alias("node"), (F.col("step") - F.lit(1 << k)).alias("step"))), "paths")
        drop(paths)
        paths = grown
    drop(nodes, *levels)
    return paths


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv, leaf, rank, score, formatted, loss): loss is an array of [start, stop) in code points of formatted."""
    said = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    turns = turns.select("conv", "leaf", "rank", "score", "step", "role", "text", F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(STOP)))
    turns = turns.withColumn("at", F.expr("sum(char_length(turn)) OVER (PARTITION BY conv, leaf, rank, score ORDER BY step, role, text ROWS UNBOUNDED PRECEDING) - char_length(turn)"))
    start = F.col("at") + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("stop"))))
    whole = turns.groupBy("conv", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "span"))).alias("turns"))
    return whole.select("conv", "leaf", "rank", "score", F.array_join("turns.turn", "").alias("formatted"), F.array_compact("turns.span").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted's columns, turns (array of role and text) and trained (the text under the loss mask, unescaped)."""
    after = lambda t: F.substring(t, len(START) + 1, 1 << 30)
    split = F.slice(F.split("formatted", r"\Q" + STOP + r"\E"), 1, F.size(F.split("formatted", r"\Q" + STOP + r"\E")) - 1)
    turn = lambda t: F.struct(unescape(F.substring_index(after(t), MIDDLE, 1)).alias("role"), unescape(F.substring_index(after(t), MIDDLE, -1)).alias("text"))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return formatted.select("*", F.transform(split, turn).alias("turns"), F.array_join(masked, "").alias("trained"))


def linear(conversations: DataFrame) -> DataFrame:
    """(conv, node, parent, score, role, text): every turn replies to the one before it, by turn, role and text."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    rows = rows.withColumn("node", F.expr("row_number() OVER (PARTITION BY conv ORDER BY turn, role, text)").cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "CASE WHEN id = 0 THEN 'user' ELSE 'assistant' END AS role", "'</s>[INST] ok [/INST]' AS text")
    stored = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = table(linear(stored.unionByName(own)), "messages")
    back = read_back(format_paths(best_paths(messages), messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(role) + length(text) + {len(START + MIDDLE + STOP)}
         + length(role || text) - length(replace(role || text, '\', ''))
         + length(regexp_replace(role, '(<\||</?s>|<</?SYS>>|\[/?INST\])', '\1+', 'g')) - length(role)
         + length(regexp_replace(text, '(<\||</?s>|<</?SYS>>|\[/?INST\])', '\1+', 'g')) - length(text) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op4_chat": op4_chat}
ORACLE_SQL = {"op4_chat": _SQL}
