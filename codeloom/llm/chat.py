"""Preference formatting of chosen and rejected conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The place of a turn without a number: before all others.
FIRST = -(2**62)


def render(role: Column, text: Column) -> Column:
    """One turn as text; a null role is ``unknown``, a null text empty."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """Segments of preference pairs from rows (pair_id, chosen boolean, turn, role, text).

    The longest common turn prefix of the two conversations of a pair becomes ``prompt`` segments, once; what follows
    becomes ``chosen`` and ``rejected`` segments. ``loss`` is 1 where a completion's turn is the assistant's, else 0.
    Turns are matched by (pair, number): all rows of one number in one conversation are one step, of which equal turns
    are one row with their number ``times``, so repeated rows meet in a count. A step is the same on both sides if each
    turn is there equally often. No conversation or step is gathered in a row or a task. A pair with one conversation has
    no prompt. A null pair_id is a pair of its own, a null number a step before the others, a null role ``unknown``, a
    null text empty, a null ``chosen`` chosen. Empty and very long texts are turns like others; other columns are
    ignored; an empty table gives no row.
    """
    side = F.coalesce("chosen", F.lit(True))
    clean = turns.select("pair_id", "turn", F.coalesce("turn", F.lit(FIRST)).alias("at"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), side.alias("chosen"))
    many = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    same = clean.groupBy("pair_id", "turn", "at", "role", "text").agg(many(F.col("chosen")).alias("good"), many(~F.col("chosen")).alias("bad"))
    # where the conversations part: the least number with a turn that is not there equally often
    fork = same.where("good <> bad").groupBy("pair_id").agg(F.min("at").alias("fork"))
    joined = same.join(fork.withColumnRenamed("pair_id", "of_pair"), F.col("pair_id").eqNullSafe(F.col("of_pair")), "left")
    common = F.col("fork").isNull() | (F.col("at") < F.col("fork"))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), n.alias("n"))
    parts = F.when(common, F.array(part("prompt", F.col("good")))).otherwise(F.array(part("chosen", F.col("good")), part("rejected", F.col("bad"))))
    flat = joined.select("pair_id", "turn", "role", "text", F.explode(parts).alias("p")).where("p.n > 0")
    loss = F.when((F.col("p.part") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0)
    return flat.select("pair_id", F.col("p.part").alias("part"), "turn", F.col("p.n").alias("times"), "role", render(F.col("role"), F.col("text")).alias("rendered"), loss.alias("loss"))


def assemble(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected text, and for the completions masks as arrays of (length, loss).

    Turns are in the order of their numbers, those of one number by role and text. A row is what a trainer reads: the two
    conversations of a pair meet in one row, so they must fit in one; segments without a pair_id are no pair and left out.
    """
    of = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct(F.coalesce("turn", F.lit(FIRST)).alias("at"), "role", "rendered", "times", "loss"))))
    rows = segments.where("pair_id is not null").groupBy("pair_id").agg(*(of(p).alias(p) for p in ("prompt", "chosen", "rejected")))
    text = lambda p: F.array_join(F.transform(p, lambda x: F.repeat(x["rendered"], x["times"].cast("int"))), "")
    mask = lambda p: F.transform(p, lambda x: F.struct((F.char_length(x["rendered"]) * x["times"]).alias("length"), x["loss"].alias("loss")))
    return rows.select("pair_id", *(text(p).alias(p) for p in ("prompt", "chosen", "rejected")), *(mask(p).alias(f"{p}_mask") for p in ("chosen", "rejected")))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made of a table of conversations: number 2k is chosen, 2k + 1 rejected, pair k."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(F.floor(conv / F.lit(2.0)).cast("long").alias("pair_id"), F.coalesce(F.pmod(conv, F.lit(2)) == 0, F.lit(True)).alias("chosen"), F.col("turn").cast("long").alias("turn"), "role", "text")


_SEGMENTS = f"""
with t as (
  select cast(floor(conv_id / 2.0) as bigint) pair_id, coalesce(((conv_id % 2) + 2) % 2 = 0, true) chosen, cast(turn as bigint) turn,
         coalesce(role, 'unknown') "role", coalesce("text", '') "text"
  from conversations
), s as (
  select pair_id, turn, "role", "text", count(*) filter (where chosen) good, count(*) filter (where not chosen) bad from t group by all
), f as (select pair_id, min(coalesce(turn, {FIRST})) fork from s where good <> bad group by pair_id)
, p as (
  select s.*, f.fork is null or coalesce(turn, {FIRST}) < f.fork common from s left join f on s.pair_id is not distinct from f.pair_id
), u as (
  select pair_id, 'prompt' part, turn, good times, "role", "text" from p where common
  union all select pair_id, 'chosen', turn, good, "role", "text" from p where not common
  union all select pair_id, 'rejected', turn, bad, "role", "text" from p where not common
), g as (
  select pair_id, part, turn, cast(times as bigint) as times, "role", '{OPEN}' || "role" || chr(10) || "text" || '{CLOSE}' || chr(10) as rendered,
    cast(case when part <> 'prompt' and "role" = 'assistant' then 1 else 0 end as integer) as loss
  from u where times > 0
)"""
SQL = f"{_SEGMENTS} select * from g"
_TEXT = """coalesce(string_agg(repeat(rendered, times), '' order by turn nulls first, "role", rendered) filter (where part = '{0}'), '') as {0}"""
_MASK = """coalesce(string_agg(length(rendered) * times || ':' || loss, ',' order by turn nulls first, "role", rendered) filter (where part = '{0}'), '') as {0}_mask"""
PAIRS_SQL = f"{_SEGMENTS} select pair_id, {', '.join(_TEXT.format(p) for p in ('prompt', 'chosen', 'rejected'))}, {', '.join(_MASK.format(p) for p in ('chosen', 'rejected'))} from g where pair_id is not null group by pair_id"
