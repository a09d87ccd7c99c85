"""Chat formatting by a grammar round trip.

A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. The parser is deterministic and always unescapes, so a
text that needs no escape is written as it is. A turn whose own rendering does not read back as that turn
is escaped: in a text each ``<``, n backslashes and ``|`` get one backslash more, and a role is written as
``~`` and the hex digits of its UTF-8. What is rendered is read back again; a conversation that still
differs has every turn escaped, and one that differs then fails the job.

Only DataFrame functions run. A conversation is one value of the result, so its turns meet in one row.

Defined results: null texts and null roles are empty; turns go by (turn, role, text), nulls first, and
repeated rows are turns of their own; null conversation ids are one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.concat(F.lit("~"), F.lower(F.hex(F.encode(role, "utf-8"))))


def unescape_role(role: Column) -> Column:
    return F.when(role.startswith("~"), F.decode(F.unhex(F.substr(role, F.lit(2))), "utf-8")).otherwise(role)


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """The turns of a rendering as array<struct<role, text, raw>>; null where it does not follow the grammar.

    ``raw`` is the text as it stands in the rendering, still escaped.
    """
    blocks = F.split(formatted, r"\Q" + START + r"\E")

    def turn(block: Column) -> Column:
        body = F.substring_index(block, END, 1)
        role = F.substring_index(body, "\n", 1)
        raw = F.substr(body, F.length(role) + 2)
        good = (F.substr(block, F.length(body) + 1) == END + "\n") & body.contains("\n")
        return F.when(good, F.struct(unescape_role(role).alias("role"), unescape_text(raw).alias("text"), raw.alias("raw")))

    turns = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turn)
    return F.when((blocks[0] == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (read back, with ``start`` and ``stop`` of the text in the rendering), escaped.

    ``start`` and ``stop`` count code points from 0, stop exclusive: over assistant turns they are the loss mask.
    """
    one = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text")
    )
    alone = parsed(written(F.col("_role"), F.col("_text")))
    same = F.coalesce((F.size(alone) == 1) & (alone[0]["role"] == F.col("_role")) & (alone[0]["text"] == F.col("_text")), F.lit(False))
    # Turns that hold none of the grammar's characters read back as they are; only the others are tried.
    suspect = F.col("_text").contains("<") | F.col("_role").contains("<") | F.col("_role").contains("\n") | F.col("_role").startswith("~")
    one = one.withColumn("_escape", F.when(suspect, ~same).otherwise(False))
    chats = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_escape").alias("escape")))).alias("_turns"))

    def rendered(everything: bool) -> Column:
        def one_turn(t: Column) -> Column:
            strict = written(escape_role(t["role"]), escape_text(t["text"]))
            return strict if everything else F.when(t["escape"], strict).otherwise(written(t["role"], t["text"]))

        return F.concat_ws("", F.transform("_turns", one_turn))

    chats = chats.withColumn("_first", rendered(False))
    agrees = F.coalesce(_plain(parsed(F.col("_first"))) == _plain(F.col("_turns")), F.lit(False))
    chats = chats.withColumn("formatted", F.when(agrees, F.col("_first")).otherwise(rendered(True))).withColumn("_back", parsed(F.col("formatted")))
    differs = ~F.coalesce(_plain(F.col("_back")) == _plain(F.col("_turns")), F.lit(False))
    chats = chats.withColumn("_back", F.when(differs, F.raise_error("a conversation does not read back as it was")).otherwise(F.col("_back")))
    # Lengths of what precedes each text: marks, written role and line feed.
    blocks = F.split(F.col("formatted"), r"\Q" + START + r"\E")
    heads = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: len(START) + 1 + F.length(F.substring_index(b, "\n", 1)))
    placed = F.aggregate(
        F.arrays_zip(F.col("_back").alias("back"), heads.alias("head")),
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<role:string,text:string,start:int,stop:int>>").alias("turns")),
        lambda a, x: F.struct(
            (a["at"] + x["head"] + F.length(x["back"]["raw"]) + len(END) + 1).cast("int").alias("at"),
            F.array_append(
                a["turns"],
                F.struct(x["back"]["role"].alias("role"), x["back"]["text"].alias("text"), (a["at"] + x["head"]).cast("int").alias("start"), (a["at"] + x["head"] + F.length(x["back"]["raw"])).cast("int").alias("stop")),
            ).alias("turns"),
        ),
    )
    return chats.select("conv_id", "formatted", placed["turns"].alias("turns"), (~agrees | F.exists("_turns", lambda t: t["escape"])).alias("escaped"))


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the rendering."""
    masked = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: unescape_text(F.substr(F.col("formatted"), t["start"] + 1, t["stop"] - t["start"])),
    )
    loss = F.concat_ws("", masked)
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return digests(format_chats(rows.unionByName(extra)))


_SAID = "<|im_end|><|im_start|>assistant ok"
#: Rendered length: 24 marks and line feeds a turn besides role and text, and an escape for each "<", backslashes, "|".
ORACLES = {
    "op2_chat_format": f"""
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
y AS (SELECT *, (contains(text, '{START}') OR contains(text, '{END}') OR regexp_matches(text, '<\\\\+\\|')) AS esc FROM x)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(text) + CASE WHEN esc THEN 1 + 2 * strlen(role) + len(regexp_extract_all(text, '<\\\\*\\|')) ELSE length(role) END) AS BIGINT) AS formatted_chars,
  bool_or(esc) AS escaped
FROM y GROUP BY conv_id"""
}
QUERIES = {"op2_chat_format": op2_chat_format}
