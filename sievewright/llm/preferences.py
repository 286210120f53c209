"""Preference formatting, with DataFrame functions only.

A chosen and a rejected conversation share their longest common prefix of turns. It is rendered once, as
the prompt; what remains of each is rendered as its completion, with the spans of the completion that
bear loss: the assistant's texts and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
_SPANS = "array<struct<start:bigint,stop:bigint>>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def _loss_spans(turns: Column) -> Column:
    """Where the assistant's texts and end marks are in the rendered turns, in characters."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(_header(turn))
        stop = start + F.length(_body(turn))
        own = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + 1).alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """Number of turns at the start in which role and text agree; nulls agree with nulls."""
    n = F.least(F.size(chosen), F.size(rejected))
    agree = F.zip_with(F.slice(chosen, 1, n), F.slice(rejected, 1, n), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    at = F.array_position(agree, False)
    return F.when(at == 0, n.cast("long")).otherwise(at - 1)


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """(id, n_prefix, prompt, chosen, rejected, chosen_loss, rejected_loss), a row for each row of `pairs`.

    Both conversations are arrays of structs with `role` and `text`; a null one counts as empty. A null role
    is 'unknown', a null text empty. If one conversation begins with all of the other, the shorter one's completion
    is empty, and so is its loss.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda name: F.coalesce(F.transform(F.col(f"`{name}`"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), empty)
    held = pairs.select(F.col(f"`{id_col}`").alias(id_col), plain(chosen_col).alias("_c"), plain(rejected_col).alias("_r"))
    cut = held.withColumn("n_prefix", common_prefix(F.col("_c"), F.col("_r")))
    rest = lambda name: F.slice(F.col(name), (F.col("n_prefix") + 1).cast("int"), F.size(name))
    parts = cut.select(id_col, "n_prefix", F.slice("_c", F.lit(1), F.col("n_prefix").cast("int")).alias("_p"), rest("_c").alias("_c"), rest("_r").alias("_r"))
    return parts.select(id_col, "n_prefix", _rendered(F.col("_p")).alias("prompt"), _rendered(F.col("_c")).alias("chosen"), _rendered(F.col("_r")).alias("rejected"), _loss_spans(F.col("_c")).alias("chosen_loss"), _loss_spans(F.col("_r")).alias("rejected_loss"))


def assembled(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>) by turn, then role, then text, nulls last in each; rows without conv_id belong
    to no conversation, and repeated rows are turns of their own."""
    own = {n: F.col(f"`{c}`") for c, n in ((turn_col, "turn"), (role_col, "role"), (text_col, "text"))}
    order = F.struct(*(x for n, c in own.items() for x in (c.isNull().alias(f"no_{n}"), c.alias(n))))  # false comes before true
    named = turns.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("conv_id"), order.alias("t"))
    sorted_ = F.array_sort(F.collect_list("t"))
    return named.groupBy("conv_id").agg(F.transform(sorted_, lambda t: t.dropFields(*(f"no_{n}" for n in own))).alias("turns"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) made of what assembled() gives: rejected is the conversation up to its last reply of
    the assistant, with the last reply of its neighbour (conv_id with the last bit flipped) in place of its own.

    Without a reply of its own, nothing is cut off; without a neighbour's reply, nothing takes its place.
    """
    back = F.array_position(F.transform(F.reverse("turns"), lambda t: F.coalesce(t["role"], F.lit(""))), "assistant")
    last = F.when(back > 0, F.size("turns") - back + 1).cast("int")
    held = conversations.withColumn("_last", last)
    reply = F.transform(F.slice("turns", F.col("_last"), F.lit(1)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    others = held.where("_last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("_other"), reply.alias("_reply"))
    paired = held.join(others, F.col("conv_id") == F.col("_other"), "left")
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    kept = F.slice(plain, F.lit(1), F.coalesce(F.col("_last") - 1, F.size("turns")))
    return paired.select("conv_id", plain.alias("chosen"), F.concat(kept, F.coalesce("_reply", none)).alias("rejected"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")


#: DuckDB SQL for the query over `conversations`: turns are rows here, not arrays.
SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, role AS own_role, text AS own_text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(i) FILTER (WHERE own_role = 'assistant') AS l FROM t GROUP BY conv_id
), rejected AS (
  SELECT t.* FROM t JOIN last USING (conv_id) WHERE l IS NULL OR i < l
  UNION ALL
  SELECT me.conv_id, t.role, t.text, t.own_role, t.own_text, coalesce(me.l, (SELECT max(i) + 1 FROM t AS z WHERE z.conv_id = me.conv_id)) AS i
  FROM last AS me JOIN last AS you ON you.conv_id = xor(me.conv_id, 1) JOIN t ON t.conv_id = you.conv_id AND t.i = you.l
), both_sides AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i) AS i,
    a.i IS NOT NULL AND b.i IS NOT NULL AND a.own_role IS NOT DISTINCT FROM b.own_role AND a.own_text IS NOT DISTINCT FROM b.own_text AS same
  FROM t AS a FULL JOIN rejected AS b ON a.conv_id = b.conv_id AND a.i = b.i
), cut AS (
  SELECT conv_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS n FROM both_sides GROUP BY conv_id
), placed AS (
  SELECT side, conv_id, i, n, role, text, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' AS body FROM (
    SELECT 'chosen' AS side, * FROM t UNION ALL SELECT 'rejected', * FROM rejected) JOIN cut USING (conv_id)
), measured AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY side, conv_id, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM placed
)
SELECT conv_id, any_value(n)::BIGINT AS n_prefix,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i <= n), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i > n), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 'rejected' AND i > n), '') AS rejected,
  coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'chosen' AND i > n AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'rejected' AND i > n AND role = 'assistant'), '') AS rejected_loss
FROM measured GROUP BY conv_id
"""
