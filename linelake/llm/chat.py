"""Chat formatting: each dialogue once for every participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Turns whose numbers share a block of so many are rendered together; the blocks of a dialogue, in order, are its text.
BLOCK = 64
#: A block's rows, in order, are rendered in parts of so many.
CROWDED = 1024
OPEN, CLOSE, SYSTEM, NOBODY = "<|im_start|>", "<|im_end|>\n", "system", "(none)"


def _piece(turn: Column, participant: Column) -> Column:
    role = (
        F.when(turn["speaker"] == SYSTEM, F.lit(SYSTEM)).when(turn["speaker"] == participant, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), turn["speaker"]))
    )
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = F.concat(F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit(CLOSE))
    return F.struct(head.alias("head"), body.alias("body"), ((turn["speaker"] == participant) & (turn["speaker"] != SYSTEM)).alias("own"))


def _placed(turns: DataFrame, block: int, crowded: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of blocks that are one part, those of larger blocks with their part, and the participants of each dialogue.

    Rows of larger blocks are dealt out by ranges; their place in the block is that in the range plus the rows in the ranges before.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn_no"),
        F.coalesce("role", F.lit(NOBODY)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct().withColumn("block", F.floor(F.col("turn_no") / block).cast("long"))
    full = rows.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("c", "b")
    same_block = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    small = rows.join(full, same_block, "left_anti").withColumn("part", F.lit(0).cast("long"))
    ranges = rows.join(full, same_block).drop("c", "b").repartitionByRange("conv_id", "block", "turn_no", "speaker", "text")
    ranges = staged(ranges.withColumn("range", F.spark_partition_id()), "turns")
    before = ranges.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("range").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("c", "b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("c", "b", "r", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block", "range").orderBy("turn_no", "speaker", "text")) - 1
    large = (
        ranges.withColumn("place", place).join(before, same_block & (F.col("range") == F.col("r")))
        .select("conv_id", "turn_no", "speaker", "text", "block", F.floor((F.col("place") + F.col("before")) / crowded).cast("long").alias("part"))
    )
    who = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("participant")).distinct()
    return small, large, who


def _rendered(placed: DataFrame, who: DataFrame) -> DataFrame:
    packed = placed.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list(F.struct("turn_no", "speaker", "text"))).alias("turns"))
    each = packed.join(who, F.col("conv_id").eqNullSafe(F.col("c")))
    pieces = each.withColumn("pieces", F.transform("turns", lambda t: _piece(t, F.col("participant"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        return F.struct(end.alias("at"), F.when(x["own"], F.array_append(s["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(s["spans"]).alias("spans"))

    return pieces.select(
        "conv_id", "participant", "block", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("pieces", start, step)["spans"].alias("mask"),
    )


def perspectives(turns: DataFrame, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """conv_id, participant, block, part, n_turns, text, mask: ``turns`` (conv_id, turn, role, text) rendered for each participant.

    Participants are a dialogue's roles other than ``system``, also in blocks where they don't speak. The participant's turns are the
    assistant's, all others are users named by their role; ``mask`` holds the (start, end) of the characters to learn from: the
    participant's own texts with the closing mark. A dialogue's rows in order of block and part are its whole text: a dialogue of up to
    64 turns has one block. Turns stand in order of number (null first), then role, then text. A part is the next ``crowded`` rows of its
    block in this order, so no task gets a whole dialogue of any length.

    A null role is ``(none)``, a null text empty. Rows that are equal in all four columns count once. Null ids form one dialogue. A
    dialogue of system turns only has no participant and no row. ``<|`` in a text becomes ``< |``. Further columns aren't looked at.
    """
    small, large, who = _placed(turns, block, crowded)
    return _rendered(small.unionByName(large), who)


def blocks(turns: DataFrame, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """conv_id, participant, block, n_turns, text, mask: ``perspectives`` with the parts of each block, of any size, put together in order.

    ``mask`` counts from the start of the block. A block is one row, so one of very many rows makes a row of their size.
    """
    small, large, who = _placed(turns, block, crowded)
    parts = _rendered(large, who).groupBy("conv_id", "participant", "block").agg(
        F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "text", "mask"))).alias("parts")
    )
    none = F.array(F.lit(0).cast("long"))
    begins = F.aggregate("parts", none, lambda s, x: F.array_append(s, F.element_at(s, -1) + F.length(x["text"])))
    shifted = F.zip_with(
        "parts", F.slice("begins", 1, F.size("parts")),
        lambda x, at: F.transform(x["mask"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"))),
    )
    whole = parts.withColumn("begins", begins).select(
        "conv_id", "participant", "block", "n_turns", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"), F.flatten(shifted).alias("mask")
    )
    return _rendered(small, who).drop("part").unionByName(whole)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.select("conv_id", "participant", "block", "n_turns", "text", F.array_join(spans, ",").alias("mask"))


OP5_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS text, floor(turn / {BLOCK})::BIGINT AS block FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker != '{SYSTEM}'),
x AS (
  SELECT t.*, participant,
         '{OPEN}' || CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head,
         replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id = p.conv_id),
y AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, block ORDER BY turn, speaker, text)::BIGINT AS upto FROM x)
SELECT conv_id, participant, block, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY turn, speaker, text) AS text,
       coalesce(string_agg((upto - length(body))::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY turn, speaker, text) FILTER (WHERE speaker = participant), '') AS mask
FROM y GROUP BY conv_id, participant, block
"""
