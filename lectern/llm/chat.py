"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens lay the turns of a conversation on a grid. The turns
inside one cell make one window; a turn that crosses a border makes a window of
its own, so a window never holds more new tokens than the cell, unless one turn
alone is longer: turns are never cut. Every window starts with the system turn,
repeats the last turns before it as far as the history budget allows, and masks
what is repeated, so each assistant text is a target exactly once.

Defined results: a null role, text or turn is an empty role, an empty text, the
first place. Rows that repeat (conversation, turn) are kept and ordered by role
and text. A null conversation id is a conversation of its own. No rows give no
windows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.prefix import running_total

# The marks of this template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings that may not occur inside a text, also those of other common templates.
_FIRST = r"([<\[])"
_REST = r"(\|im_start\|>|\|im_end\|>|/?s>|</?SYS>>|/?INST\])"
HEADER_TOKENS = 4
SLICE = 1024


def escape(text: Column) -> Column:
    """Puts one more backslash behind the first character of every control string, plain or escaped before."""
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break, which ends the role, is written as backslash n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn as budgeted: four bytes each, and the header."""
    return F.ceil(F.octet_length(text) / 4) + HEADER_TOKENS


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """One row per window of (conv_id, turn, role, text).

    Returns conv_id, window (its order within the conversation), formatted, loss
    (start and length of each target in code points of ``formatted``), n_context
    (turns at the start that are repeated from before) and n_turns (all turns).
    """
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = running_total(rows, ["conv_id"], F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))), order, "tokens", "start")

    first = (F.col("start") == 0) & (F.col("role") == "system")
    system = placed.where(first).select(
        F.col("conv_id").alias("s_conv"), F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens"),
    )
    # The system turn is part of every window, so what it takes is not left for others.
    cell = F.greatest(F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)), F.lit(history + 1))
    placed = (
        placed.join(system.select("s_conv", "s_tokens"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
        .withColumn("is_system", first)
        .withColumn("cell", cell)
        .withColumn("end", F.col("start") + F.col("tokens"))
        .withColumn("k", F.floor(F.col("start") / F.col("cell")))
        .withColumn("window", F.col("k") * 2 + (F.col("end") > (F.col("k") + 1) * F.col("cell")).cast("long"))
    )
    after = Window.partitionBy("conv_id").orderBy("window")  # one narrow row per window
    windows = placed.groupBy("conv_id", "window").agg(F.max("end").alias("w_end")).select(
        F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), "w_end", F.lead("window").over(after).alias("w_next"),
    )
    placed = placed.join(windows, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("window") == F.col("w_window")))
    repeated = F.col("w_next").isNotNull() & (F.col("w_end") - F.col("start") <= history) & ~F.col("is_system")
    uses = F.array_compact(F.array(
        F.struct(F.col("window"), F.lit(True).alias("fresh")),
        F.when(repeated, F.struct(F.col("w_next").alias("window"), F.lit(False).alias("fresh"))),
    ))
    piece = F.struct("start", "turn", "role", "text", "fresh")
    grouped = (
        placed.withColumn("use", F.explode(uses))
        .select("conv_id", "start", "turn", "role", "text", "use.*", (F.col("is_system") & F.col("use.fresh")).alias("has_system"))
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("has_system").alias("has_system"))
        .join(system.select("s_conv", "s_text"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    )
    lead = F.when(
        F.col("s_text").isNotNull() & ~F.col("has_system"),
        F.array(F.struct(F.lit("system").alias("role"), F.col("s_text").alias("text"), F.lit(False).alias("fresh"))),
    ).otherwise(F.array().cast("array<struct<role:string,text:string,fresh:boolean>>"))
    told = F.concat(lead, F.transform("pieces", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"), p["fresh"].alias("fresh"))))
    marked = F.transform(told, lambda p: F.struct(
        F.concat(F.lit(OPEN), escape_role(p["role"]), F.lit("\n")).alias("head"),
        escape(p["text"]).alias("body"),
        (p["fresh"] & (p["role"] == "assistant")).alias("target"),
        p["fresh"].alias("fresh"),
    ))
    tail = CLOSE + "\n"

    def lay(state: Column, p: Column) -> Column:
        at = state["at"] + F.length(p["head"])
        span = F.array(F.struct(at.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct(
            (at + F.length(p["body"]) + len(tail)).alias("at"),
            F.when(p["target"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"),
        )

    # Positions count from 1, as substring() does. A window is bounded by its budget, so is this fold.
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    laid = grouped.withColumn("marked", marked)
    return laid.select(
        "conv_id", "window",
        F.array_join(F.transform("marked", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("marked", zero, lay)["loss"].alias("loss"),
        F.size(F.filter("marked", lambda p: ~p["fresh"])).alias("n_context"),
        F.size("marked").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of one window as (role, text), as they were before formatting."""
    return F.transform(F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30), lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(p.substr(
            F.length(F.substring_index(p, "\n", 1)) + 2,
            F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE) - 1,
        )).alias("text"),
    ))


def op10_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back from the output.

    A conversation's digest needs its whole text, so here, and only here, one row holds one conversation.
    """
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = format_windows(turns).select(
        "conv_id", "window", F.length("formatted").alias("chars"),
        F.slice(read_turns(F.col("formatted")), F.col("n_context") + 1, F.greatest(F.col("n_turns"), F.lit(1))).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "").alias("lost"),
    )
    per = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "lost"))).alias("w"), F.sum("chars").alias("formatted_chars"),
    )
    every = F.flatten(F.col("w.turns"))
    lost = F.array_join(F.col("w.lost"), "")
    digest = F.array_join(F.transform("every", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.withColumn("every", every).withColumn("lost", lost).select(
        "conv_id", F.size("every").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) + {HEADER_TOKENS} AS tokens,
         {len(OPEN) + len(CLOSE) + 2} + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_FIRST}(\\*){_REST}', '\1\\\2\3', 'g'))
           + length(regexp_replace(text, '{_FIRST}(\\*){_REST}', '\1\\\2\3', 'g')) AS chars
  FROM turns
), placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) AS stop FROM sized
), systems AS (
  SELECT conv_id, tokens AS s_tokens, chars AS s_chars FROM placed WHERE n = 1 AND role = 'system'
), celled AS (
  SELECT *, stop - tokens AS start, greatest(1024 - 192 - coalesce(s_tokens, 0), 193) AS cell FROM placed LEFT JOIN systems USING (conv_id)
), laid AS (
  SELECT *, 2 * (start // cell) + CAST(stop > (start // cell + 1) * cell AS INT) AS win FROM celled
), windows AS (
  SELECT conv_id, win, max(stop) AS w_end, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS next FROM laid GROUP BY conv_id, win
), told AS (
  SELECT laid.*, chars * (1 + CAST(next IS NOT NULL AND w_end - start <= 192 AND (n > 1 OR s_chars IS NULL) AS INT)) AS all_chars
  FROM laid JOIN windows USING (conv_id, win)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(all_chars) + coalesce(max(s_chars), 0) * (count(DISTINCT win) - 1) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""
