"""Chat formatting: a dialogue from the perspective of each of its participants, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
NARRATOR = "system"  # gives instructions, takes no part in the dialogue
BLOCK_TURNS = 1024  # turns of a conversation that one window holds


def _escaped(text: Column) -> Column:
    """Text without any marker: each `<|` has one more bar. Taking it away gives the text back."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _one_line(name: Column) -> Column:
    """A name that can neither end its line nor hold a marker; different names stay different."""
    for plain, spelled in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(plain), F.lit(spelled))
    return _escaped(name)


def rotate(turns: DataFrame) -> DataFrame:
    """`(conv_id, perspective, turn, speaker, chat_role, name, segment, body_start, train, start, stop)` for each turn of
    `turns(conv_id, turn, role, text)` and each participant of its conversation.

    In the perspective of a participant its own turns are the assistant's and are learned from (`train`, from the body to
    the end marker: `body_start` is the first character of `segment` to learn from); the others' are those of a user with
    that name; the narrator's stay instructions. `start` and `stop` are the places of the segment in the rendered
    dialogue, which is the segments in order of (`turn`, `speaker`, text).

    Markers in texts are spelled with one more bar, and so are those in names, whose line breaks and backslashes are spelled
    out; both can be undone, so different texts and names stay different. `dialogues` renders whole dialogues.

    No dialogue is gathered in one row: places come from lengths summed over blocks of BLOCK_TURNS turn numbers, then
    within the block, so a conversation of any length is many small windows. A null text is empty, a null turn stands
    first, a null role is a participant called `unknown`, a null conv_id is a conversation of its own. Repeated turns are
    kept, side by side. A conversation of narrators alone has no perspective. Other columns are not read.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        _escaped(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
    ).withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit(-(1 << 62)).cast("long")))
    people = said.where(F.col("speaker") != NARRATOR).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(people, said.conv_id.eqNullSafe(people["_conv"])).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    chat_role = F.when(own, "assistant").when(F.col("speaker") == NARRATOR, "system").otherwise("user")
    name = F.when(chat_role == "user", F.col("speaker"))
    head = F.concat(F.lit(START), chat_role, F.coalesce(F.concat(F.lit(" name="), _one_line(name)), F.lit("")), F.lit("\n"))
    rows = rows.select(
        "conv_id", "perspective", "turn", "speaker", chat_role.alias("chat_role"), name.alias("name"), "_block",
        F.concat(head, "_text", F.lit(END)).alias("segment"), F.length(head).cast("long").alias("body_start"), own.alias("train"),
    ).withColumn("_size", F.length("segment").cast("long"))
    blocks = rows.groupBy("conv_id", "perspective", "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(
        F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_block").alias("_b"), "_before"
    )
    placed = rows.join(
        blocks, rows.conv_id.eqNullSafe(blocks["_c"]) & (rows.perspective == blocks["_p"]) & (rows["_block"] == blocks["_b"])
    )
    inside = (
        Window.partitionBy("conv_id", "perspective", "_block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    stop = F.col("_before") + F.sum("_size").over(inside)
    return placed.withColumn("stop", stop).select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", "name", "segment", "body_start", "train",
        (F.col("stop") - F.col("_size")).alias("start"), "stop",
    )


def dialogues(turns: DataFrame, most_characters: int = 1 << 20) -> DataFrame:
    """`(conv_id, perspective, n_turns, n_characters, text, train)` for each participant of each conversation: the rendered
    dialogue and the places in it to learn from, as `(start, stop)` from a body to behind its end marker.

    Only dialogues of at most `most_characters` are gathered in a row; of longer ones `text` and `train` are null, and
    `rotate` has their segments with their places. Nulls and odd rows: as in `rotate`."""
    placed = rotate(turns)
    sizes = placed.groupBy("conv_id", "perspective").agg(F.count("*").alias("n_turns"), F.max("stop").alias("n_characters"))
    own = sizes.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p")).where(F.col("n_characters") <= most_characters)
    short = placed.join(own, placed.conv_id.eqNullSafe(own["_c"]) & (placed.perspective == own["_p"]), "left_semi")
    pieces = F.sort_array(F.collect_list(F.struct("start", "segment", "train", "body_start", "stop")))
    gathered = short.groupBy(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p")).agg(pieces.alias("_pieces"))
    span = lambda p: F.struct((p["start"] + p["body_start"]).alias("start"), p["stop"].alias("stop"))
    out = sizes.join(gathered, sizes.conv_id.eqNullSafe(gathered["_c"]) & (sizes.perspective == gathered["_p"]), "left")
    return out.select(
        "conv_id", "perspective", "n_turns", "n_characters", F.array_join("_pieces.segment", "").alias("text"),
        F.transform(F.filter("_pieces", lambda p: p["train"]), span).alias("train"),
    )


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '<||') AS body
  FROM conversations
), people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'),
roled AS (
  SELECT conv_id, perspective, turn, speaker, body,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c
), rendered AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS name,
         '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || replace(replace(replace(replace(speaker, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), '<|', '<||') ELSE '' END || chr(10) AS head
  FROM roled
), laid AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM rendered
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn ASC NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM laid
)
SELECT conv_id, perspective, turn, speaker, chat_role, name, segment, CAST(length(head) AS BIGINT) AS body_start,
       speaker = perspective AS train, CAST(stop - length(segment) AS BIGINT) AS start, stop
FROM placed
"""
