"""Chat formatting: the dialogue once per participant, with that speaker as the assistant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import query, table

#: turns of one rendered piece; longer dialogues go on in the next piece
PART_TURNS = 256
#: turn numbers that are ranked together before parts are cut
SLICE = 1000


def chat_perspectives(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    context_roles: Sequence[str] = ("system",), part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per conversation, perspective and part: ``conv_id, perspective, part, n_turns, text, loss_spans``.

    Every role of a conversation except ``context_roles`` is a participant; a null role is the participant
    ``unknown``. From a participant's perspective their own turns are the assistant's and carry the loss mask:
    ``loss_spans`` lists (start, end) code-point offsets of their bodies with end marks. Others are users with
    their name, context roles are system. Turns stand by (turn, role, text), null turns last; ties and repeated rows are kept.
    Null text renders as empty; ``<|`` inside texts and names is broken up so that it cannot pose as a mark. Rows
    with a null conversation form one conversation. A conversation of context turns only has no perspective; an
    empty table gives no rows.

    Ranks come from slices of the turn number and one row per slice, and a part holds ``part_turns``
    turns, so no task gathers a long dialogue.
    """
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("-")).alias("key"),
        F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit((1 << 62))))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("key", "slice").count().select("key", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("key", "slice").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    ranked = rows.withColumn("n", F.row_number().over(within)).join(slices, ["key", "slice"]).withColumn("rank", F.col("offset") + F.col("n") - 1)
    ranked = ranked.withColumn("part", F.floor(F.col("rank") / part_turns))

    context = F.col("role").isin(*context_roles) if context_roles else F.lit(False)
    people = rows.filter(~context).select("key", F.col("role").alias("perspective")).distinct()
    mine = F.col("role") == F.col("perspective")
    head = F.when(mine, F.lit("<|assistant|>\n")).when(context, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user name="), plain(F.col("role")), F.lit("|>\n")))
    views = ranked.join(people, "key").select(
        "key", "conv_id", "perspective", "part", "rank", head.alias("head"), F.concat(plain(F.col("text")), F.lit("<|end|>\n")).alias("body"), mine.alias("mine"))
    pieces = views.groupBy("key", "perspective", "part").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("rank", "head", "body", "mine"))).alias("m"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, m):
        body_at = acc["at"] + F.length(m["head"])
        end = body_at + F.length(m["body"])
        own = F.array(F.struct(body_at.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["mine"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id", "perspective", F.col("part").cast("bigint").alias("part"), F.size("m").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("m", start, add)["spans"].alias("loss_spans"))


ORACLE = """
WITH r AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rank FROM conversations),
v AS (
  SELECT r.conv_id, p.role AS perspective, r.rank // 256 AS part, r.rank, r.role = p.role AS mine,
    CASE WHEN r.role = p.role THEN '<|assistant|>' WHEN r.role = 'system' THEN '<|system|>' ELSE '<|user name=' || replace(r.role, '<|', '< |') || '|>' END || chr(10) AS head,
    replace(r.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM r JOIN (SELECT DISTINCT conv_id, role FROM r WHERE role != 'system') p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rank) AS e FROM v)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS text,
  string_agg((e - length(body)) || '-' || e, ',' ORDER BY rank) FILTER (WHERE mine) AS loss_spans
FROM o GROUP BY conv_id, perspective, part
"""


@query("op5_chat_perspectives", ORACLE)
def op5_chat_perspectives(spark, sf_dir):
    out = chat_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return out.withColumn("loss_spans", F.when(F.size("loss_spans") > 0, spans))
