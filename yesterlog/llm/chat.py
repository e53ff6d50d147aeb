"""Chat formatting of reply trees.

Every message knows its parent. Root-to-leaf paths come from iterative self-joins by pointer doubling: round k joins the
table "ancestor 2^k steps up" with itself, so a chain of d messages takes log2(d) rounds, not d. Doubling also sums the
scores from leaf to root, by which the branches of a tree are ranked; the ancestors of each chosen leaf are then listed by
joining the rounds' tables in reverse, each ancestor once. Each path becomes one conversation.

Template: a turn is "<s>" role "[INST]" text "[/INST]" "</s>". A control string inside a role or text gets one more
backslash behind its first character ("</s>" -> "<\\/s>", "<\\/s>" -> "<\\\\/s>"), which `unescape` takes away again.
loss_spans are the code-point ranges of assistant texts in the formatted string.

Defined results: null role or text is empty, a null score 0; a message whose parent is missing is a root; messages on a cycle
have no root and belong to no path; ties in score go to the smaller leaf id. Rows with a null tree are one tree of their own,
named null in the result; a row with a null node is left out. Of rows with the same tree and node the least by parent (null
first), role, text and score counts; `linear_nodes` gives every row a node of its own. An empty table gives no conversation.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, load

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")


def escape(s: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", s)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<s>{escape(role)}[INST]", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}[/INST]</s>")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for piece in formatted.split("[/INST]</s>")[:-1]:
        role, _, text = piece.removeprefix("<s>").partition("[INST]")
        turns.append((unescape(role), unescape(text)))
    return turns


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text as a tree without branches: a turn's parent is the turn before it."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    node = F.row_number().over(w).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), (node - 1).alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


KEY = ["none", "tree"]


def _keyed(messages: DataFrame) -> DataFrame:
    """Messages with a key that is never null (whether the tree's name is null, and the name), one row for each node."""
    named = messages.filter("node is not null").withColumn("none", F.col("tree").isNull()).withColumn("tree", F.coalesce("tree", F.lit(0)))
    named = named.select(*KEY, "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rest = ["parent", "role", "text", "score"]
    return named.groupBy(*KEY, "node").agg(F.min(F.struct(*rest)).alias("m")).select(*KEY, "node", *[f"m.{c}" for c in rest])


def _named(paths: DataFrame, *columns: str) -> DataFrame:
    return paths.select(F.when(~F.col("none"), F.col("tree")).alias("tree"), *columns)


def _paths(nodes: DataFrame, keep: int) -> DataFrame:
    """nodes: none, tree, node, parent, score. The rows of `reply_paths` by key."""
    known = nodes.select(*KEY, F.col("node").alias("up"))
    # rounds[k]: the nodes that have an ancestor 2^k steps up, and the scores of the steps, the ancestor's not included
    rounds = [cut(nodes.withColumnRenamed("parent", "up").join(known, [*KEY, "up"], "left_semi").select(*KEY, "node", "up", "score"), "chat-up0")]
    n = nodes.count()
    while 2 ** len(rounds) <= n and not rounds[-1].isEmpty():
        a, b = rounds[-1], rounds[-1].select(*KEY, F.col("node").alias("up"), F.col("up").alias("higher"), F.col("score").alias("more"))
        rounds.append(cut(a.join(b, [*KEY, "up"]).select(*KEY, "node", F.col("higher").alias("up"), (F.col("score") + F.col("more")).alias("score")), f"chat-up{len(rounds)}"))
    parents = rounds[0].select(*KEY, F.col("up").alias("node")).distinct()
    leaves = nodes.select(*KEY, "node").join(parents, [*KEY, "node"], "left_anti").select(*KEY, F.col("node").alias("leaf"), "node", F.lit(0.0).alias("score"))
    for k in range(len(rounds) - 1, -1, -1):
        step = rounds[k].select(*KEY, "node", F.col("up").alias("higher"), F.col("score").alias("more"))
        leaves = leaves.join(step, [*KEY, "node"], "left").select(*KEY, "leaf", F.coalesce("higher", "node").alias("node"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    roots = nodes.join(rounds[0].select(*KEY, "node"), [*KEY, "node"], "left_anti").select(*KEY, "node", F.col("score").alias("own"))
    best = Window.partitionBy(*KEY).orderBy((F.col("score") + F.col("own")).desc(), "leaf")
    chosen = leaves.join(roots, [*KEY, "node"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    paths = cut(chosen.select(*KEY, "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height")), "chat-leaves")
    for k in range(len(rounds) - 1, -1, -1):  # each round writes only the ancestors that it adds
        above = paths.join(rounds[k].select(*KEY, "node", "up"), [*KEY, "node"]).select(*KEY, "leaf", "rank", F.col("up").alias("node"), (F.col("height") + 2**k).alias("height"))
        paths = paths.unionByName(cut(above, f"chat-path{k}"))
    return paths


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages: tree, node, parent, role, text, score. Returns tree, leaf, rank, node, height (0 at the leaf) of the `keep` best paths of each tree."""
    return _named(_paths(cut(_keyed(messages).drop("role", "text"), "chat-ids"), keep), "leaf", "rank", "node", "height")


def _format(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in frame.turns]
        spans = [[{"start": a, "stop": b} for a, b in m[1]] for m in made]
        yield pd.DataFrame({"tree": frame.tree.astype("Int64"), "leaf": frame.leaf, "rank": frame["rank"], "formatted": [m[0] for m in made], "loss_spans": spans})


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages: tree, node, parent, role, text, score. Returns tree, leaf, rank, formatted, loss_spans: a row for each chosen path."""
    nodes = cut(_keyed(messages), "chat-nodes")
    turns = _paths(nodes.drop("role", "text"), keep).join(nodes.select(*KEY, "node", "role", "text"), [*KEY, "node"]).groupBy(*KEY, "leaf", "rank")
    turns = _named(turns.agg(F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("at"), "role", "text"))).alias("turns")), "leaf", "rank", "turns")
    return turns.mapInPandas(_format, "tree long, leaf long, rank int, formatted string, loss_spans array<struct<start:long,stop:long>>")


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for frame in frames:
        rows = []
        for conv, text, spans in zip(frame.tree.astype("Int64"), frame.formatted, frame.loss_spans, strict=True):
            turns = parse_turns(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = cut(format_trees(linear_nodes(rows)), "chat-formatted")
    return formatted.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS esc,
            regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS resc FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>') + length(resc) + length('[INST]') + length(esc) + length('[/INST]</s>'))::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""
