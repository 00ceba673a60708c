"""Preference formatting: the longest common turn prefix of two conversations as prompt, and both rests as masked completions.

DataFrame functions only. A pair's turns meet in one row, since the result is one row for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def consecutive_pairs(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """pair_id, chosen, rejected: conversation 2 n against 2 n + 1, pair_id n."""
    ids = conversations.select(F.shiftright(F.col(conv_id).cast("long"), 1).alias("pair_id")).where("pair_id IS NOT NULL").distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen"), (F.col("pair_id") * 2 + 1).alias("rejected"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _segments(turns: Column, learn: str) -> Column:
    """Each turn as three pieces: its head, what is learned if its role is `learn` (text and end mark), the line's end."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.flatten(F.transform(turns, lambda t: F.array(piece(_head(t), F.lit(False)), piece(F.concat(t["text"], F.lit(CLOSE)), t["role"] == learn), piece(F.lit("\n"), F.lit(False)))))


def preference_pairs(conversations: DataFrame, pairs: DataFrame, learn: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of pairs (pair_id, chosen, rejected: conv_ids) both of whose conversations have turns.

    n_prefix: turns from the start that are equal in role and text; prompt: these, written once; chosen, rejected: the turns after them;
    chosen_mask, rejected_mask: a 1 for each code point that is learned (text and end mark of turns of role `learn`) and
    a 0 for others; chosen_segments, rejected_segments: the same as array<struct<text, loss>>.
    Turns are in order of turn (null first), then role, then text; a repeated row is a turn said twice. A null role or text counts as
    empty. Rows without conv_id belong to no conversation. Equal conversations have empty completions. A conversation may
    be in many pairs: turns are gathered once for each conversation, and pairs join the gathered rows.
    """
    said = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("__conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("__t"))
    whole = said.groupBy("__conv").agg(F.transform(F.sort_array(F.collect_list("__t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("__turns"))
    c = whole.select(F.col("__conv").alias("__c"), F.col("__turns").alias("__ct"))
    r = whole.select(F.col("__conv").alias("__r"), F.col("__turns").alias("__rt"))
    both = pairs.join(c, F.col("chosen") == F.col("__c")).join(r, F.col("rejected") == F.col("__r"))
    shorter = F.least(F.size("__ct"), F.size("__rt"))
    differ = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.element_at("__ct", i) != F.element_at("__rt", i))
    both = both.withColumn("n_prefix", F.coalesce(F.array_min(differ) - 1, shorter))
    rest = lambda x: F.slice(x, F.col("n_prefix") + 1, F.size(x))
    both = both.select(
        "pair_id", F.col("chosen").alias("chosen_id"), F.col("rejected").alias("rejected_id"), "n_prefix",
        _segments(F.slice("__ct", F.lit(1), F.col("n_prefix")), learn).alias("__p"), _segments(rest("__ct"), learn).alias("chosen_segments"), _segments(rest("__rt"), learn).alias("rejected_segments"),
    )
    words = lambda x: F.array_join(F.transform(x, lambda s: s["text"]), "")
    mask = lambda x: F.array_join(F.transform(x, lambda s: F.repeat(F.when(s["loss"], F.lit("1")).otherwise(F.lit("0")), F.length(s["text"]))), "")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_prefix", words("__p").alias("prompt"),
        words("chosen_segments").alias("chosen"), words("rejected_segments").alias("rejected"),
        mask("chosen_segments").alias("chosen_mask"), mask("rejected_segments").alias("rejected_mask"),
        "chosen_segments", "rejected_segments",
    )


SQL = """
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r FROM t GROUP BY pair_id HAVING c > 0 AND r > 0),
d AS (SELECT a.pair_id, min(a.i) AS first FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
      WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
p AS (SELECT n.pair_id, coalesce(d.first - 1, least(n.c, n.r))::INTEGER AS n_prefix FROM n LEFT JOIN d ON n.pair_id = d.pair_id),
w AS (SELECT p.pair_id, p.n_prefix, t.side, t.i, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS said,
             repeat('0', 13 + length(t.role)) || repeat(CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END, length(t.text) + 10) || '0' AS mask
      FROM p JOIN t ON p.pair_id = t.pair_id)
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, n_prefix,
       coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 0 AND i <= n_prefix), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 0 AND i > n_prefix), '') AS chosen,
       coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 1 AND i > n_prefix), '') AS rejected,
       coalesce(string_agg(mask, '' ORDER BY i) FILTER (side = 0 AND i > n_prefix), '') AS chosen_mask,
       coalesce(string_agg(mask, '' ORDER BY i) FILTER (side = 1 AND i > n_prefix), '') AS rejected_mask
FROM w GROUP BY pair_id, n_prefix
"""
