"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as
the assistant and all others as users who are named. Loss is taken on what the assistant says: the
mask holds the character spans of those turns' texts and their end marks.

A turn reads ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` where ROLE is ``assistant``, ``user
name=SPEAKER`` or, for turns by ``system``, which nobody can be, ``system``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.frames import load

START, END = "<|im_start|>", "<|im_end|>"
NOBODY = "system"
UNNAMED = "unknown"


def _plain(x: Column) -> Column:
    """Text that can't be taken for a mark."""
    return F.regexp_replace(x, "<\\|(im_start|im_end)\\|>", "<$1>")


def perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conversation, perspective, rendered, mask, n_turns, n_own) for each participant of each conversation.

    mask: array of struct(start, end), in characters, end exclusive, in order.

    Turns are ordered by turn, then speaker and text, nulls first; rows that repeat are turns of
    their own. A null text is an empty one, a null or empty speaker is ``unknown``, a null
    conversation is one conversation. Marks within a text or a name lose their bars. Conversations
    in which only the system speaks have no perspective. Other columns don't matter.
    """
    who = F.when(F.coalesce(F.trim(F.col(speaker)), F.lit("")) == "", UNNAMED).otherwise(_plain(F.col(speaker)))
    rows = turns.select(F.col(conversation).alias("c"), F.struct(F.col(turn).alias("turn"), who.alias("who"), _plain(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    talks = rows.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    each = talks.withColumn("me", F.explode(F.array_sort(F.array_distinct(F.filter(F.col("turns.who"), lambda x: x != NOBODY)))))

    def head(t: Column) -> Column:
        role = F.when(t.who == F.col("me"), "assistant").when(t.who == NOBODY, NOBODY).otherwise(F.concat(F.lit("user name="), t.who))
        return F.concat(F.lit(START), role, F.lit("\n"))

    def body(t: Column) -> Column:
        return F.concat(t.text, F.lit(END))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (t.who == F.col("me")).alias("mine")))
    each = each.withColumn("parts", parts)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc.at + F.length(p.head)
        end = start + F.length(p.body)
        return F.struct((end + 1).alias("at"), F.when(p.mine, F.concat(acc.spans, F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc.spans).alias("spans"))

    mask = F.aggregate("parts", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc.spans)
    return each.select(
        F.col("c").alias(conversation),
        F.col("me").alias("perspective"),
        F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("rendered"),
        mask.alias("mask"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p.mine)).alias("n_own"),
    )


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perspectives(load(spark, sf_dir, "conversations"))
    return rows.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s.start, s.end)), " "))


QUERIES = {"op3_chat_perspectives": op3_chat_perspectives}
ORACLES = {
    "op3_chat_perspectives": f"""
with turns as (
  select conv_id, turn, case when trim(coalesce(role, ''), ' ') = '' then '{UNNAMED}' else role end as who, coalesce(text, '') as text
  from conversations
), people as (
  select distinct conv_id, who as me from turns where who <> '{NOBODY}'
), parts as (
  select t.conv_id, me, turn, who, text, who = me as mine,
    '{START}' || case when who = me then 'assistant' when who = '{NOBODY}' then who else 'user name=' || who end || chr(10) as head,
    text || '{END}' as body
  from turns t join people p using (conv_id)
), placed as (
  select *, cast(coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, me order by turn, who, text rows between unbounded preceding and 1 preceding), 0) + length(head) as integer) as start
  from parts
)
select conv_id, me as perspective,
  string_agg(head || body || chr(10), '' order by turn, who, text) as rendered,
  string_agg(start || '-' || (start + length(body)), ' ' order by turn, who, text) filter (where mine) as mask,
  cast(count(*) as integer) as n_turns,
  cast(count(*) filter (where mine) as integer) as n_own
from placed
group by conv_id, me
"""
}
