"""Chat formatting over reply trees.

A forest of messages (tree, node, parent, role, text, score) becomes root-to-leaf paths.
Iterative self-joins double the distance each round: after k rounds a node knows its ancestor
2**k steps up, its depth and the sum of scores so far, so a chain of n messages takes log2(n)
rounds. Leaves are ranked within their tree by score (ties: shorter first, then the smaller
leaf), and for the chosen leaves the same jump tables list every ancestor once. Each chosen path
is formatted as one conversation.

Template: `<turn ROLE>\\n`, the text, `</turn>\\n` for each turn. In texts and roles a backslash
becomes `\\\\` and `<` becomes `\\l` (in roles also `>` `\\g` and a line feed `\\n`), so no control
string of the template occurs inside a text, and reading back is exact. The loss mask is the
spans of the assistant's (escaped) texts.

Defined results: a null text is empty, a null role too; a parent that isn't there makes a root;
a node that only a cycle leads to has no root and is on no path; of nodes with equal (tree, node) one stays:
the smallest by (parent, role, text); a null tree is a tree of its own; nodes without id are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, read

_TURN = re.compile(r"<turn ([^>\n]*)>\n([^<]*)</turn>\n")
_BACK = {"\\\\": "\\", "\\l": "<", "\\g": ">", "\\n": "\n"}


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\l")
    return text.replace(">", "\\g").replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lgn]", lambda m: _BACK[m[0]], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans under the loss mask, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role, True)}>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; an error where it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def reply_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, path_rank, path_score, depth, node, role, text): the nodes of each tree's `top` best root-to-leaf paths (all: None).

    nodes has tree, node, parent, role, text, score; trees are hashed, so no task needs a
    whole tree until paths are put together, and a path is as long as its own output.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "reply-paths")
    kept = nodes.filter("node is not null").groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("x")
    )
    kept = scratch.write(kept.select("tree", "node", "x.*"), "nodes")

    up = kept.select(F.col("tree"), F.col("node").alias("above")).alias("u")
    links = kept.alias("n").join(up, F.col("n.tree").eqNullSafe(F.col("u.tree")) & (F.col("n.parent") == F.col("u.above")), "left")
    # far: the ancestor 2**k up; steps, total: how many messages and what score from there (not included) to here.
    # Rows that have reached their root are done and are only looked up, so a round costs what is still open.
    start = scratch.write(
        links.select("n.tree", "n.node", F.col("u.above").alias("far"), F.lit(1).cast("long").alias("steps"), F.col("n.score").alias("total")),
        "jump-0"
    )
    jumps, done, open_before = [start.filter("far is not null")], [start.filter("far is null")], None
    while True:
        open_now = jumps[-1].count()
        if open_now == 0 or open_now == open_before:  # what doesn't shrink hangs on cycles
            break
        open_before = open_now
        a, b = jumps[-1].alias("a"), reduce(DataFrame.unionByName, [jumps[-1], *done]).alias("b")
        met = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.far") == F.col("b.node")))
        met = scratch.write(
            met.select("a.tree", "a.node", "b.far", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total")),
            f"jump-{len(jumps)}"
        )
        jumps.append(met.filter("far is not null"))
        done.append(met.filter("far is null"))

    depth = reduce(DataFrame.unionByName, done).select("tree", "node", "steps", "total")
    parents = kept.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = depth.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    if top == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("cost"), "steps", "node")).alias("x"))
        chosen = best.select("tree", F.col("x.node").alias("leaf"), F.lit(1).alias("path_rank"), (-F.col("x.cost")).alias("path_score"))
    else:
        w = Window.partitionBy("tree").orderBy(F.desc("total"), "steps", "node")
        chosen = leaves.select("tree", F.col("node").alias("leaf"), F.row_number().over(w).alias("path_rank"), F.col("total").alias("path_score"))
        chosen = chosen if top is None else chosen.filter(F.col("path_rank") <= top)
    parts = [scratch.write(chosen.withColumn("at", F.col("leaf")), "path")]
    for jump in reversed(jumps[:-1]):  # each offset is a sum of different powers of two, so each ancestor comes once
        on_path = reduce(DataFrame.unionByName, parts)
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("at_"), "far")
        further = on_path.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("at_"))).withColumn("at", F.col("far"))
        parts.append(scratch.write(further.select(*on_path.columns), f"path-{len(parts)}"))
    on_path = reduce(DataFrame.unionByName, parts)
    told = kept.join(
        depth.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("steps").alias("depth")),
        F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    )
    told = told.select(F.col("tree").alias("t"), "node", "role", "text", "depth")
    joined = on_path.join(told, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("node")))
    return joined.select("tree", "leaf", "path_rank", "path_score", "depth", "node", "role", "text")


def gather(paths: DataFrame) -> DataFrame:
    """(tree, leaf, path_rank, path_score, turns): a path's turns in order; a row is one conversation."""
    turns = F.array_sort(F.collect_list(F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return paths.groupBy("tree", "leaf", "path_rank", "path_score").agg(turns.alias("turns"))


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, path_rank, path_score, formatted, loss_spans) of what reply_paths returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b.turns]
            yield b.drop(columns="turns").assign(formatted=[m[0] for m in made], loss_spans=[[{"start": s, "end": e} for s, e in m[1]] for m in made])

    paths = gather(paths)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema if f.name != "turns")
    return paths.mapInPandas(run, f"{kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def chain(rows: DataFrame, conv: str, turn: str) -> DataFrame:
    """Conversations listed turn by turn as trees without branches: a row's parent is the row before it by (turn, role, text)."""
    w = Window.partitionBy(conv).orderBy(F.asc_nulls_first(turn), "role", "text")
    at = rows.select(F.col(conv).cast("long").alias("tree"), F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return at.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for conv, formatted, spans in zip(b.tree, b.formatted, b.loss_spans, strict=True):
            turns = parse_turns(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append(
                (
                    conv, len(turns), hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)
                )
            )
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = format_paths(reply_paths(chain(rows.unionByName(more), "conv_id", "turn")))
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss_spans").mapInPandas(_digests, kind)


#: Turns by conversation in order, escaped as the template does; the template's own marks are 12 code points a turn and the role.
OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + 16 + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))) AS chars
  FROM c GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""
