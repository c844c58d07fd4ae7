"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, one conversation for each chosen path."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_table, redeal, text_or_empty, write_table

BEGIN, ROLE, TEXT, END = "<s>", "<|role|>", "<|text|>", "<|end|>"
#: Strings that never stand unescaped in a role or text: our own marks' start, and marks that other chat templates use.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(ROLE) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def escape(s: str) -> str:
    r"""Double each backslash and put one after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask: code point ranges of the assistant's texts in it."""
    out, at, mask = [BEGIN], len(BEGIN), []
    for role, text in turns:
        head, body = ROLE + escape(role) + TEXT, escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def masked_text(formatted: str, mask) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in mask)


def climb(messages: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, high, n, s), one for each doubling: the message 2 ** k above, and number and summed scores of those from the node up to it.

    ``messages``: tree, node, parent, score. Where ``high`` is null, n and s reach the root. A
    parent that is missing in its tree makes a root. No path is longer than its tree has
    messages: what the last table, which reaches further than the largest tree, hasn't
    finished leads round in a circle. Every table has a row for each message.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_has"))
    rows = messages.join(redeal(known, "tree", "parent"), ["tree", "parent"], "left")
    rows = rows.select("tree", "node", F.when(F.col("_has"), F.col("parent")).alias("high"), F.lit(1).cast("long").alias("n"), F.col("score").alias("s"))
    levels = [write_table(rows, "climb")]
    largest = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(levels) - 1)) < largest and not (last := levels[-1]).where("high is not null").isEmpty():
        above = last.select("tree", F.col("node").alias("high"), F.col("high").alias("_high"), F.col("n").alias("_n"), F.col("s").alias("_s"))
        on = last.where("high is not null").join(redeal(above, "tree", "high"), ["tree", "high"])
        on = on.select("tree", "node", F.col("_high").alias("high"), (F.col("n") + F.col("_n")).alias("n"), (F.col("s") + F.col("_s")).alias("s"))
        levels.append(write_table(last.where("high is null").unionByName(on), "climb"))
    return levels


def paths_up(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up): the messages from each of ``leaves`` (tree, leaf) to its root, by joins that double what is known of each path."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, level in enumerate(levels[:-1]):
        step = level.where("high is not null").select("tree", "node", "high")
        more = paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("high").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        longer = write_table(paths.unionByName(more), "paths")
        drop_table(paths)
        paths = longer
    return paths


def best_conversations(messages: DataFrame, top_k: int | None = None) -> DataFrame:
    """(tree, leaf, score, rank, turns): the chosen branches with their turns from the root down.

    ``messages``: tree, node, parent, role, text, score. A branch scores the mean of
    its messages' scores (null: 0); ties go to the smaller leaf. ``top_k`` branches of
    each tree are kept, all if it is None. Null role or text: empty. Rows without
    tree or node belong to no path. Of repeated nodes of a tree one is kept (the
    smallest by parent, role, text, score). Texts may be of any length, though a
    conversation must fit in a row. Other columns are not looked at, so none clashes. An
    empty table gives no conversations.
    """
    clean = messages.where("tree is not null and node is not null").select(
        "tree", "node", "parent", text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    clean = write_table(
        clean.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*"), "messages"
    )
    levels = climb(clean)
    # Branches are ranked by what their leaves sum up; only the chosen ones are spelt out.
    inner = clean.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = levels[-1].where("high is null").join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("s") / F.col("n")).alias("score"))
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    ranked = write_table(ranked, "branches")
    on_path = paths_up(ranked, levels)
    turns = on_path.select("tree", "leaf", "node", "up").join(ranked, ["tree", "leaf"]).join(clean.select("tree", "node", "role", "text"), ["tree", "node"])
    grouped = turns.groupBy("tree", "leaf", "score", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("o"), "role", "text"))).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


_FORMATTED = "formatted string, mask array<struct<start:long,end:long>>"


def _format(turns: pd.Series) -> pd.DataFrame:
    done = [format_turns((t["role"], t["text"]) for t in x) for x in turns]
    return pd.DataFrame({"formatted": [f for f, _ in done], "mask": [[{"start": a, "end": b} for a, b in m] for _, m in done]})


def format_conversations(messages: DataFrame, top_k: int | None = None) -> DataFrame:
    """tree, leaf, score, rank, formatted (string) and mask (code point ranges of what is learned) of the chosen branches."""
    best = best_conversations(messages, top_k)
    return best.withColumn("out", F.pandas_udf(_format, _FORMATTED)("turns")).select("tree", "leaf", "score", "rank", "out.formatted", "out.mask")


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: pd.Series, mask: pd.Series) -> pd.DataFrame:
    """Digests of what the formatted conversation and its loss mask say."""
    rows = []
    for f, m in zip(formatted, mask):
        turns, loss = parse_turns(f), masked_text(f, [(x["start"], x["end"]) for x in m])
        rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(f)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def linear_messages(turns: DataFrame) -> DataFrame:
    """A table of turns as reply trees without branches: each turn answers the one before it (null turns first; ties: by role, text).

    The tree is a struct (none, id), so that turns without a conv_id make a conversation too.
    """
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return turns.withColumn("node", n).select(
        tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    out = format_conversations(linear_messages(turns.unionByName(extra)))
    return out.withColumn("d", F.pandas_udf(read_back, _DIGESTS)("formatted", "mask")).select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"), "d.*")


def tree_query(spark, sf_dir):
    """The two best branches of each conversation read as a tree: turn n answers turn n / 2, as the table itself has no branches."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null").select("conv_id", "turn", "role", "text")
    nodes = linear_messages(turns).withColumns({"parent": F.when(F.col("node") > 1, F.floor(F.col("node") / 2)), "score": F.pmod(F.length(text_or_empty(F.col("text"))), F.lit(7)).cast("double"), "tree": F.col("tree.id")})
    out = format_conversations(nodes, top_k=2)
    return out.withColumn("d", F.pandas_udf(read_back, _DIGESTS)("formatted", "mask")).select(F.col("tree").alias("conv_id"), "leaf", "rank", "d.*")


def _sql_escape(x: str) -> str:
    for s in ("\\", *CONTROL):
        x = f"replace({x}, '{s}', '{(s + s) if len(s) == 1 else s[0] + chr(92) + s[1:]}')"
    return x


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', 'a'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', 'b'))
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(BEGIN)} + sum({len(ROLE) + len(TEXT) + len(END)} + length({_sql_escape('role')}) + length({_sql_escape('text')})))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

TREE_SQL = f"""
WITH RECURSIVE nodes AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (SELECT conv_id, max(n) AS m FROM nodes GROUP BY conv_id),
paths(conv_id, leaf, n) AS (
  SELECT conv_id, n, n FROM nodes JOIN sizes USING (conv_id) WHERE 2 * n > m UNION ALL SELECT conv_id, leaf, n // 2 FROM paths WHERE n > 1
),
scored AS (SELECT p.conv_id, leaf, sum(length(text) % 7) / count(*) AS score FROM paths p JOIN nodes x ON x.conv_id = p.conv_id AND x.n = p.n GROUP BY p.conv_id, leaf),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, leaf) AS rank FROM scored) WHERE rank <= 2)
SELECT b.conv_id, b.leaf::BIGINT AS leaf, b.rank::INTEGER AS rank, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p.n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY p.n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(BEGIN)} + sum({len(ROLE) + len(TEXT) + len(END)} + length({_sql_escape('role')}) + length({_sql_escape('text')})))::BIGINT AS formatted_chars
FROM best b JOIN paths p ON p.conv_id = b.conv_id AND p.leaf = b.leaf JOIN nodes x ON x.conv_id = p.conv_id AND x.n = p.n GROUP BY b.conv_id, b.leaf, b.rank
"""
