"""Reply trees as conversations: choose a branch of each tree and format it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep

# Marks of the template.  A turn is OPEN role SEP text CLOSE.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Strings that models read as control: the template's own and two common ones.
# A text's own such string gets one more backslash after its first character.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def reply_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The messages on the best root-to-leaf paths of each reply tree.

    ``messages``: conv_id, message_id, parent_id, score (null: 0).  A message
    whose parent is null or missing is a root.  Each round joins the messages
    with themselves and doubles the distance to the known ancestor, so a tree of
    depth ``d`` takes about log2(d) rounds; the summed scores travel along.
    Leaves rank by the mean score of their path, then by depth (deepest first),
    then by the smaller message_id.  Returns conv_id, path (1 is the best),
    depth (0 is the root) and message_id.  The chosen paths are walked back by
    the same doubled steps, so no path is listed for a leaf that is not chosen.

    A null conv_id is one conversation; messages with a null message_id or on a
    circle of replies have no root and are left out; of repeated rows one stays;
    no messages give no rows.
    """
    plain = (
        messages.where("message_id IS NOT NULL")
        .groupBy("conv_id", "message_id")
        .agg(F.min("parent_id").alias("parent_id"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    )
    parents = plain.select(F.col("conv_id").alias("_c"), F.col("message_id").alias("_m"))
    # jump: the ancestor 2^k steps up (null beyond the root); dist and total cover the steps so far.
    first = plain.join(parents, _same("conv_id", "_c") & (F.col("parent_id") == F.col("_m")), "left")
    level = keep(
        first.select(
            "conv_id",
            "message_id",
            F.col("_m").alias("jump"),
            F.lit(1).cast("bigint").alias("dist"),
            F.col("score").cast("double").alias("total"),
        ),
        "reply-level",
    )
    nodes, levels, open_before = level, [], None
    while True:
        levels.append(level)
        still = level.where("jump IS NOT NULL").count()
        if not still or still == open_before:
            break
        open_before = still
        up = level.select(
            F.col("conv_id").alias("_c"),
            F.col("message_id").alias("_m"),
            F.col("jump").alias("_jump"),
            F.col("dist").alias("_dist"),
            F.col("total").alias("_total"),
        )
        longer = (
            level.where("jump IS NOT NULL")
            .join(up, _same("conv_id", "_c") & (F.col("jump") == F.col("_m")))
            .select(
                "conv_id",
                "message_id",
                F.col("_jump").alias("jump"),
                (F.col("dist") + F.col("_dist")).alias("dist"),
                (F.col("total") + F.col("_total")).alias("total"),
            )
        )
        # What has reached its root is carried over as it is.
        level = keep(longer.unionByName(level.where("jump IS NULL")), "reply-level")
    with_replies = nodes.where("jump IS NOT NULL").select(F.col("conv_id").alias("_c"), F.col("jump").alias("_m"))
    # Rows that still have an ancestor now are on a circle or below one.
    leaves = level.where("jump IS NULL").join(
        with_replies.distinct(), _same("conv_id", "_c") & (F.col("message_id") == F.col("_m")), "left_anti"
    )
    rank = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("dist")), F.desc("dist"), "message_id")
    chosen = (
        leaves.withColumn("path", F.row_number().over(rank))
        .where(F.col("path") <= paths)
        .select("conv_id", "path", "message_id", (F.col("dist") - 1).alias("depth"))
    )
    chosen = keep(chosen, "reply-chosen")
    for k in range(len(levels) - 1, -1, -1):
        steps = levels[k].where("jump IS NOT NULL").select(
            F.col("conv_id").alias("_c"), F.col("message_id").alias("_m"), "jump"
        )
        above = chosen.join(steps, _same("conv_id", "_c") & (F.col("message_id") == F.col("_m"))).select(
            "conv_id", "path", F.col("jump").alias("message_id"), (F.col("depth") - 2**k).alias("depth")
        )
        wider = keep(chosen.unionByName(above), "reply-chosen")
        forget(chosen)
        forget(levels[k])
        chosen = wider
    return chosen


def format_paths(rows: DataFrame) -> DataFrame:
    """One formatted conversation per (conv_id, path) from rows (conv_id, path, depth, role, text).

    Returns conv_id, path, n_turns, formatted and loss: the spans of assistant
    texts in ``formatted``, in code points, end exclusive.  Null roles and texts
    are empty; every other role is kept as it is.  A conversation is one output
    row, so one must fit into a row; its turns are laid out by a running sum of
    their lengths and then put together.
    """
    turn = Window.partitionBy("conv_id", "path").orderBy("depth")
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(SEP))
    laid = rows.select("conv_id", "path", "depth", "role", head.alias("_head"), text.alias("_text"))
    laid = laid.withColumn("_turn", F.concat("_head", "_text", F.lit(CLOSE)))
    laid = laid.withColumn("_end", F.sum(F.length("_turn").cast("bigint")).over(turn))
    end = F.col("_end") - len(CLOSE)
    mask = F.when(F.col("role") == "assistant", F.struct((end - F.length("_text")).alias("start"), end.alias("end")))
    return (
        laid.withColumn("_mask", mask)
        .groupBy("conv_id", "path")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "_turn", "_mask"))).alias("_turns"))
        .select(
            "conv_id",
            "path",
            F.size("_turns").cast("bigint").alias("n_turns"),
            F.array_join(F.col("_turns._turn"), "").alias("formatted"),
            F.expr("filter(_turns._mask, m -> m IS NOT NULL)").alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from ``formatted`` and ``loss`` alone."""
    turns = F.expr(f"slice(split(formatted, '{_pattern(OPEN)}'), 2, greatest(size(split(formatted, '{_pattern(OPEN)}')) - 1, 0))")
    sep, close = F.lit(SEP), len(CLOSE)
    parsed = F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, SEP, 1)).alias("role"),
            unescape(
                F.substr(
                    t,
                    F.instr(t, sep) + F.lit(len(SEP)),
                    F.length(t) - F.instr(t, sep) - F.lit(len(SEP) + close - 1),
                )
            ).alias("text"),
        ),
    )
    # Escapes never reach over the end of a text, so the parts can be restored one by one.
    loss = F.transform(
        "loss",
        lambda m: unescape(
            F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
        ),
    )
    return formatted.withColumns({"turns": parsed, "loss_text": F.array_join(loss, "")})


def _pattern(mark: str) -> str:
    return mark.replace("|", "[|]")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`read_back` finds."""
    back = read_back(formatted)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def format_chats(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The best paths of reply trees as formatted conversations.

    ``messages``: conv_id, message_id, parent_id, score, role, text; see
    :func:`reply_paths` and :func:`format_paths`.  Of several rows with one id
    the one with the greatest role and text counts.
    """
    chosen = reply_paths(messages.select("conv_id", "message_id", "parent_id", "score"), paths)
    said = (
        messages.groupBy(F.col("conv_id").alias("_c"), F.col("message_id").alias("_m"))
        .agg(F.max(F.struct("role", "text")).alias("_said"))
    )
    rows = chosen.join(said, _same("conv_id", "_c") & (F.col("message_id") == F.col("_m")))
    return format_paths(rows.select("conv_id", "path", "depth", "_said.role", "_said.text"))


def chain(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees of one branch, in the order of turns.

    Each row answers the one before it; rows of one turn follow one another by
    role and text, nulls first.  Repeated rows are turns of their own.
    """
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(turn).cast("bigint").alias("message_id"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return numbered.withColumns({"parent_id": parent, "score": F.lit(0.0)})
