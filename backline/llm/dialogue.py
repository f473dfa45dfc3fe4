"""Chat formatting: every participant's view of a conversation.

For each participant the dialogue is rendered once, with that speaker as the assistant, the other speakers as named
users and context roles (system) as they are.  ``loss`` holds the spans of the rendered text that a model is
trained on: the speaker's own words and the end mark after them.

A conversation is rendered in parts of ``part_turns`` consecutive turn numbers, so no row and no task has to hold a
conversation of any length; parts are put together in order of ``part``.

Defined cases: a null role is a speaker called 'unknown'; a null text is empty; turns of the same number are ordered by
role and text; turns without a number come last, in parts chosen by their text; a null conv_id is a conversation;
repeated rows are repeated turns; a conversation of context roles only has no view; empty tables give empty results.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_UNNUMBERED = 1 << 40


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS, context_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """Rows (conv_id, speaker, part, n_turns, n_own, text, loss); ``loss`` is 'start:end' in characters, comma-joined."""
    role = F.coalesce("role", F.lit("unknown"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_"))  # marks inside a text are no marks
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(_UNNUMBERED) + F.pmod(F.xxhash64("role", "text"), F.lit(1024)))
    turns = conversations.select("conv_id", part.alias("part"), F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), body.alias("body")).alias("t"))
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    speakers = conversations.select(F.col("conv_id").alias("c"), role.alias("speaker")).where(~F.col("speaker").isin(list(context_roles))).distinct()
    pairs = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def header(t: Column) -> Column:
        name = F.when(t["role"] == F.col("speaker"), F.lit("assistant")).when(t["role"].isin(list(context_roles)), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    segments = F.transform("turns", lambda t: F.struct(header(t).alias("head"), F.concat(t["body"], F.lit(CLOSE)).alias("rest"), (t["role"] == F.col("speaker")).alias("own")))
    view = pairs.select("conv_id", "speaker", "part", segments.alias("s"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + F.length(s["head"])
        after = first + F.length(s["rest"])
        # the line break that closes the end mark is not learned
        span = F.concat_ws(":", first.cast("string"), (after - 1).cast("string"))
        return F.struct(after.alias("at"), F.when(s["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    own = F.size(F.filter("s", lambda s: s["own"]))
    return view.select(
        "conv_id",
        "speaker",
        "part",
        F.size("s").cast("long").alias("n_turns"),
        own.cast("long").alias("n_own"),
        F.concat_ws("", F.transform("s", lambda s: F.concat(s["head"], s["rest"]))).alias("text"),
        F.concat_ws(",", F.aggregate("s", start, step)["spans"]).alias("loss"),
    )


ORACLE_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|im_', '< |im_') as body,
         cast(floor(turn / {PART_TURNS}) as bigint) as part
  from conversations),
speakers as (select distinct conv_id as c, role as speaker from turns where role <> 'system'),
views as (
  select conv_id, speaker, part, turn, role, body,
         '{OPEN}' || case when role = speaker then 'assistant' when role = 'system' then role else 'user name=' || role end || chr(10) as head,
         body || '{CLOSE.strip()}' || chr(10) as rest
  from turns join speakers on conv_id is not distinct from c),
placed as (
  select *, coalesce(sum(length(head) + length(rest)) over (partition by conv_id, speaker, part order by turn, role, body rows between unbounded preceding and 1 preceding), 0) as start
  from views)
select conv_id, speaker, part, count(*) as n_turns, count(*) filter (role = speaker) as n_own,
       string_agg(head || rest, '' order by turn, role, body) as text,
       coalesce(string_agg(cast(start + length(head) as bigint) || ':' || cast(start + length(head) + length(rest) - 1 as bigint), ',' order by turn, role, body) filter (role = speaker), '') as loss
from placed group by conv_id, speaker, part
"""
