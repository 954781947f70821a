"""Multi-party chat formatting, native: one rendering of a dialogue for each participant.

In a participant's rendering its own turns are the assistant's, the others' are a named user's and
system turns stay the system's.  Target spans cover the assistant's words and end marks, as character
offsets into the rendering.  Long dialogues come in segments of `segment_turns` turn numbers, each rendered from offset 0.
A segment of more rows than `segment_rows`, whose turns share numbers or have none, comes in parts, so no row gathers more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"[\x00-\x1F\x7F]"  # could forge a header in a name


def _safe(column):
    """Text in which no mark of the template begins."""
    return F.replace(column, F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(conversations: DataFrame, segment_turns: int = 256, system: str = "system", segment_rows: int = 4096) -> DataFrame:
    """Render conversations (conv_id, turn, role, text) once per participant and segment.

    Returns conv_id, perspective, segment, part, n_turns, n_targets, rendered, target_spans ("begin:end" in
    characters, joined by commas).  A participant is a role other than `system`; control characters in a role become spaces, a null
    role is the participant "unknown", a null text is empty, a null turn stands before all others in segment -1, a null conv_id is a
    dialogue of its own.  Every row is a turn, repeated ones too; turns that share a number stand in order of role and
    text.  A dialogue of system turns alone has no rendering.  Other columns are ignored; an empty table gives no rows.
    """
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1)).cast("long").alias("segment"),
        F.struct(F.col("turn").cast("long").alias("turn"), _safe(F.regexp_replace(F.coalesce(F.col("role"), F.lit("unknown")), _CONTROL, " ")).alias("role"), _safe(F.coalesce(F.col("text"), F.lit(""))).alias("text")).alias("t"),
    )
    key = ["conv", "none", "segment"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("t")) - 1
    numbered = turns.withColumn("place", place).withColumn("part", F.floor(F.col("place") / segment_rows).cast("long"))
    segments = numbered.groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct("place", F.col("t.role").alias("role"), F.col("t.text").alias("text")))).alias("turns"))
    roles = turns.select(*key, F.col("t.role").alias("perspective")).distinct()
    speakers = roles.where(F.col("perspective") != system).select("conv", "none", "perspective").distinct()
    who = roles.select(*key).distinct().join(speakers, ["conv", "none"])  # without texts, which so move once: window, sum and join share their key
    who = segments.join(who, key)

    head = lambda t: F.when(t.role == system, F.lit(f"{START}{system}\n")).when(t.role == F.col("perspective"), F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), t.role, F.lit("\n")))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t.text, F.lit(END)).alias("body"), (t.role == F.col("perspective")).alias("target")))
    rendered = who.withColumn("parts", parts)
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans")),
        lambda a, p: F.struct(
            (a.at + F.length(p.head) + F.length(p.body) + 1).cast("long").alias("at"),
            F.when(p.target, F.concat(a.spans, F.lit(","), (a.at + F.length(p.head)).cast("string"), F.lit(":"), (a.at + F.length(p.head) + F.length(p.body)).cast("string"))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: F.ltrim(a.spans, F.lit(",")),
    )
    return rendered.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        "perspective",
        "segment",
        "part",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p.target)).cast("long").alias("n_targets"),
        F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("rendered"),
        spans.alias("target_spans"),
    )


ORACLE = f"""
WITH c AS (
  SELECT conv_id, coalesce(floor(turn / 256.0), -1)::BIGINT AS segment, turn,
         replace(regexp_replace(coalesce(role, 'unknown'), '{_CONTROL}', ' ', 'g'), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM c),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.*, place // 4096 AS part, p.perspective, t.role = p.perspective AS target, text || '{END}' AS body,
         CASE WHEN role = 'system' THEN '{START}system' WHEN role = p.perspective THEN '{START}assistant' ELSE '{START}user name=' || role END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, segment, part, perspective ORDER BY place) - length(body) - 1 AS begins
  FROM r)
SELECT conv_id, perspective, segment, part::BIGINT AS part, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE target)::BIGINT AS n_targets,
       string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(begins::BIGINT || ':' || (begins + length(body))::BIGINT, ',' ORDER BY begins) FILTER (WHERE target), '') AS target_spans
FROM o GROUP BY conv_id, perspective, segment, part
"""
