"""Multi-party dialogues from the perspective of each participant.

For every participant of a conversation the whole dialogue is rendered once with
that speaker as the assistant and all others as named users.  Only the turns of
that speaker, with their end mark, are trained on; their spans are character
offsets into the rendered text.  Turns of the ``system`` role frame the dialogue:
they keep their role and are nobody's perspective.

A long conversation is rendered in chunks of ``chunk_turns`` turn numbers.
Where numbers are missing, negative or repeated a chunk can have more turns than
that; it is then cut by position into parts of ``chunk_turns`` turns.  So a row
has a bounded number of turns and no task has to hold a conversation whole;
joined by chunk and part, the rows are the dialogue.  Positions are counted in
ranges of the order, and equal turns travel as one row with their number.

Nulls: a null conversation id is a conversation of its own; a null role is the
speaker ``unknown``; a null text is an empty turn; turns without a number come
first, in chunk 0.  Repeated rows stay, ordered by their text.  A conversation
of system turns alone has no participant and gives no row; an empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.operators.ordering import number_in_ranges, range_id

SYSTEM = "system"
CHUNK_TURNS = 256
_LEAD = 256  # characters of a text that bound a range; the whole text orders within it

_START, _END = "<|im_start|>", "<|im_end|>\n"


def header(speaker: Column, perspective: Column) -> Column:
    """The line before a turn, seen by ``perspective``."""
    role = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant")).otherwise(
        F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(_START), role, F.lit("\n"))


def cut_turns(rows: DataFrame, size: int, small_rows: int | None = None) -> DataFrame:
    """``rows`` (``conv``, ``no_conv``, ``name``, ``chunk``, ``turn``, ``said``,
    ``who``) as one row per conversation, chunk and part of ``size`` turns, with
    the ordered ``turns``.  ``small_rows`` as in ``range_id``."""
    keys = ["no_conv", "name", "chunk"]
    same = rows.groupBy("conv", *keys, "turn", "said", "who").agg(F.count("*").alias("times"))
    same = same.withColumn("lead", F.left("said", F.lit(_LEAD)))
    bucket = range_id(same, ["turn", "lead"], None, small_rows, keys)
    cut = same if bucket is None else same.withColumn("_range", bucket)
    placed = number_in_ranges(cut, ["turn", "said", "who"], "last", keys, "times")
    first, last = F.col("last") - F.col("times"), F.col("last")
    parts = placed.withColumn("part", F.explode(F.sequence(F.floor(first / size), F.floor((last - 1) / size))))
    copies = F.least(last, (F.col("part") + 1) * size) - F.greatest(first, F.col("part") * size)
    turns = F.sort_array(F.collect_list(F.struct("turn", "said", "who", copies.cast("int").alias("copies"))))
    return parts.groupBy(*keys, "part").agg(F.first("conv").alias("conv"), turns.alias("turns")).withColumn(
        "turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["copies"]))))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", chunk_turns: int = CHUNK_TURNS, small_rows: int | None = None) -> DataFrame:
    """One row per conversation, participant, chunk and part: ``conv_id``, ``speaker``,
    ``chunk``, ``part``, ``n_turns``, ``text``, ``spans`` (array of start and end, end
    exclusive) and ``n_trained`` (characters in the spans)."""
    turn, conv = F.coalesce(F.col(turn_col), F.lit(-1)), F.col(conv_col)
    rows = turns.select(
        conv.alias("conv"), conv.isNull().alias("no_conv"), F.coalesce(conv.cast("string"), F.lit("")).alias("name"),
        F.greatest(F.floor(turn / chunk_turns), F.lit(0)).alias("chunk"), turn.alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("who"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    speakers = rows.where(F.col("who") != SYSTEM).select("no_conv", "name", F.col("who").alias("speaker")).distinct()
    seen = cut_turns(rows, chunk_turns, small_rows).join(speakers, ["no_conv", "name"])
    parts = F.transform("turns", lambda t: F.struct(
        header(t["who"], F.col("speaker")).alias("head"), F.concat(t["said"], F.lit(_END)).alias("body"),
        (t["who"] == F.col("speaker")).alias("own")))
    seen = seen.select("conv", "speaker", "chunk", "part", parts.alias("parts"))
    place = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(
        "array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["head"])
        end = start + F.char_length(part["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["own"], F.concat(state["spans"], span)).otherwise(
            state["spans"]).alias("spans"))

    spans = F.aggregate("parts", place, add, lambda s: s["spans"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "")
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return seen.select(F.col("conv").alias("conv_id"), "speaker", "chunk", "part", F.size("parts").cast("long").alias("n_turns"),
                       text.alias("text"), spans.alias("spans")).withColumn("n_trained", trained)
