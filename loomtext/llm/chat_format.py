"""Chat formatting from event logs: final messages are folded from events, then rendered by a template with a loss mask.

A log has rows (conv_id, seq, kind, turn, role, text). In the order of seq, within a conversation,

    message     opens a turn with a role and a text; what the turn held before goes
    delta       appends its text to the turn, as an answer is streamed
    edit        replaces the turn's text
    regenerate  empties the turn and drops all turns after it; its role stays, and later events fill it again

The fold needs no conversation in one place: per turn the last event that resets it and the last regeneration are pre-aggregated, a
running maximum over a conversation's turns (one small row each) gives the event up to which a turn was dropped by an earlier one, and
events after both bounds are put together by turn. So a conversation with a third of all events is dealt out by its turns. Only the
rendered conversation, which is one row of the output, gathers its final messages.

The template writes a turn as <s>role[INST]text[/INST]</s>. Control strings inside roles and texts get a backslash after their first
letter, and those that look like escaped ones get one more, so that `unescaped` restores every text. `formatted` returns segments
(text, loss): put together they are the formatted conversation, and texts of assistants, and nothing else, are under the loss mask.

Everything is built from DataFrame functions: no Python runs on the executors.

Cases: null texts and roles are empty ones; events that agree in all columns count once; of events with one seq the resetting one comes
first, the largest text last; a null conv_id is a conversation, a null turn the first turn, a null seq the first event; turns may be of
any type that has an order; texts of any length are kept whole; an empty log gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, TEXT, END = "<s>", "[INST]", "[/INST]</s>"
#: Control strings, and how far they are escaped already: first letter, backslashes, rest.
CONTROL, ESCAPED = r"([<\[])(\\*)(/?(?:s>|INST\]))", r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
LEARNED = "assistant"
#: Code points of a streamed delta in the log that op12 reads.
PIECE = 400


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the final messages of each conversation."""
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63)))
    events = log.select("conv_id", "turn", seq.alias("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind") != "delta"
    turns = events.groupBy("conv_id", "turn").agg(F.max(F.when(resets, F.col("seq"))).alias("reset"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    earlier = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    bounds = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "reset", F.max("again").over(earlier).alias("dropped"))
    here = events.join(bounds, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")))
    here = here.filter(F.col("dropped").isNull() | (F.col("seq") > F.col("dropped")))
    text = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    event = F.struct("seq", (~resets).alias("delta"), text.alias("text"))
    lasting = F.collect_set(F.when(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")), event))
    role = F.max_by(F.when(F.col("role").isNotNull(), F.col("role")), F.when(F.col("role").isNotNull(), F.struct("seq", "role")))
    out = here.groupBy("conv_id", "turn").agg(F.coalesce(role, F.lit("")).alias("role"), F.sort_array(lasting).alias("events"))
    opening = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("events", lambda e: ~e["delta"]), lambda e: e["text"])), -1)
    streamed = F.array_join(F.transform(F.filter("events", lambda e: e["delta"]), lambda e: e["text"]), "")
    return out.select("conv_id", "turn", "role", F.concat(opening, streamed).alias("text"))


def rendered(final: DataFrame) -> DataFrame:
    """conv_id and segments (text, loss) of conversations, from their messages (conv_id, turn, role, text)."""
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    turn = F.array(
        segment(F.concat(F.lit(START), escaped(F.col("role")), F.lit(TEXT)), no),
        segment(escaped(F.col("text")), F.col("role") == LEARNED),
        segment(F.lit(END), no),
    )
    together = final.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("segments")))).alias("turns"))
    return together.select("conv_id", F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"))


def formatted(log: DataFrame) -> DataFrame:
    """conv_id and segments (text, loss) of each conversation of a log."""
    return rendered(messages(log))


def whole_text(segments: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation, read from its text alone."""
    turns = F.split(text, r"\Q" + END + r"\E")
    parts = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: F.split(t, r"\Q" + TEXT + r"\E", 2))
    return F.transform(parts, lambda p: F.struct(unescaped(F.substr(p[0], F.lit(len(START) + 1))).alias("role"), unescaped(p[1]).alias("text")))


def learned(segments: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def streamed(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log by which rows (conv_id, turn, role, text) came about: each opens a message, and its text follows in deltas.

    Rows of one turn are messages of their own, in the order of role and text.
    """
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    event = lambda seq, kind, role, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    opened = F.array(event(F.lit(0), "message", F.col("role"), F.lit("")))
    events = F.concat(opened, F.transform(pieces, lambda p, k: event(k + 1, "delta", F.lit(None).cast("string"), p)))
    rows = rows.select("conv_id", "turn", "role", "text", nth.alias("nth"))
    return rows.select("conv_id", F.struct("turn", "nth").alias("turn"), F.explode(events).alias("event")).select("conv_id", "turn", "event.*")


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests that are read back from formatted conversations (conv_id, segments)."""
    rows = conversations.withColumn("whole", whole_text(F.col("segments"))).withColumn("learned", learned(F.col("segments")))
    rows = rows.withColumn("turns", parsed(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("whole").cast("long").alias("formatted_chars"),
    )


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    saying = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(saying).alias("text"))
    return digests(formatted(streamed(rows.union(more))))


def oracle_sql() -> str:
    """DuckDB SQL for op12_chat_format: turns in order, and lengths of escaped texts."""
    long_as = lambda c: rf"length(regexp_replace({c}, '{CONTROL}', '\1\\\2\3', 'g'))"
    ordered = "order by turn nulls first, role nulls first, text nulls first"
    return f"""
with c as (
  select conv_id, turn, role, text, coalesce(role, '') r, coalesce(text, '') t from (
    select conv_id, turn, role, text from conversations union all
    select -1, unnest([0, 1]), unnest(['user', '{LEARNED}']), '</s>[INST] ok [/INST]')),
g as (
  select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {ordered})) turns_sha256,
    coalesce(string_agg(t, '' {ordered}) filter (r = '{LEARNED}'), '') learned, sum({len(START + TEXT + END)} + {long_as('r')} + {long_as('t')})::bigint formatted_chars
  from c group by conv_id)
select conv_id, n_turns, turns_sha256, length(learned)::bigint loss_chars, sha256(learned) loss_sha256, formatted_chars from g"""
