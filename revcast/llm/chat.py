"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is rendered by this grammar::

    conversation := "<s>" turn*
    turn := "[INST] " text " [/INST]"                      role user
          | "[ASST] " text " </s>"                         role assistant
          | "[ROLE] " role newline text " [/ROLE]"         any other role

and read back by a deterministic parser: the next control string decides. A
turn is first rendered as it is and read back on its own; where the recovered
role or text differ (it holds a control string, or something that looks like
an escaped one), its text is escaped and rendered again. Escaping puts one
more backslash into each control string, after its bracket, however many
there are; reading takes one away, so it is reversible for every text, and
texts without such strings stay as they are. ``round_trip_failures`` counts
conversations whose recovered turns differ from the source: none.

The loss mask covers the texts of assistant turns, without the markers.

Defined results: a null text or role is empty; turns of a conversation are in
the order of turn (null first), role, text; repeated rows are turns of their
own; rows with a null conv_id are one conversation; an empty table gives no
rows. Turns are checked and escaped row by row; only the finished strings of
a conversation meet, because its one output row holds all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Control strings with any number of backslashes after the bracket, and with one at least.
_ANGLE = (r"<(\\*)(/?s>)", r"<\\(\\*)(/?s>)")
_SQUARE = (r"\[(\\*)(/?(?:INST|ASST|ROLE)\])", r"\[\\(\\*)(/?(?:INST|ASST|ROLE)\])")
_TURN = r"(?s)\[INST\] .*? \[/INST\]|\[ASST\] .*? </s>|\[ROLE\] .*? \[/ROLE\]"


def escape(text):
    """One more backslash in each control string."""
    out = F.regexp_replace(text, _ANGLE[0], r"<\\$1$2")
    return F.regexp_replace(out, _SQUARE[0], r"[\\$1$2")


def unescape(text):
    """One backslash less in each escaped control string."""
    out = F.regexp_replace(text, _ANGLE[1], "<$1$2")
    return F.regexp_replace(out, _SQUARE[1], "[$1$2")


def _escape_role(role):
    """A role is one line: backslashes and line ends are written as two characters."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def _unescape_role(role):
    # every backslash of a written role begins a pair, so pairs are read from the left
    return F.array_join(F.transform(
        F.regexp_extract_all(unescape(role), F.lit(r"(?s)\\.|[^\\]+"), F.lit(0)),
        lambda p: F.when(p == "\\n", "\n").when(p == "\\\\", "\\").otherwise(p)), "")


def _rendered(role, text):
    return (F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(role == "assistant", F.concat(F.lit("[ASST] "), text, F.lit(" </s>")))
            .otherwise(F.concat(F.lit("[ROLE] "), _escape_role(role), F.lit("\n"), text, F.lit(" [/ROLE]"))))


def parse(formatted):
    """The turns of a formatted string: an array of (role, text, shown), ``shown`` as it stands in the string."""

    def one(turn):
        kind = F.substring(turn, 1, 7)
        body = F.regexp_extract(turn, r"(?s)^\[(?:INST|ASST|ROLE)\] (.*) (?:\[/INST\]|</s>|\[/ROLE\])$", 1)
        other = kind == "[ROLE] "
        shown = F.when(other, F.regexp_extract(body, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(body)
        role = F.when(kind == "[INST] ", "user").when(kind == "[ASST] ", "assistant").otherwise(
            _unescape_role(F.regexp_extract(body, r"(?s)^([^\n]*)\n", 1)))
        return F.struct(role.alias("role"), unescape(shown).alias("text"), shown.alias("shown"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row: conv_id, turn, role, text (nulls empty), whether it was escaped, and its rendered string."""
    plain = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = plain.withColumn("__raw", _rendered(F.col("role"), F.col("text"))).withColumn("__read", parse(F.col("__raw")))
    same = ((F.size("__read") == 1) & (F.col("__read")[0]["role"] == F.col("role")) & (F.col("__read")[0]["text"] == F.col("text"))
            & (F.length(escape(F.col("text"))) == F.length("text")))
    return read.withColumn("escaped", ~F.coalesce(same, F.lit(False))).select(
        "conv_id", "turn", "role", "text", "escaped",
        F.when(F.col("escaped"), _rendered(F.col("role"), escape(F.col("text")))).otherwise(F.col("__raw")).alias("rendered"))


def format_conversations(rows: DataFrame, **columns: str) -> DataFrame:
    """Per conversation: conv_id, formatted, and the source's turns as an array of (role, text)."""
    turns = format_turns(rows, **columns)
    all_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    return turns.groupBy("conv_id").agg(all_turns.alias("__turns")).select(
        "conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("__turns", lambda t: t.rendered), "")).alias("formatted"),
        F.transform("__turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text, shown), recovered from the strings alone."""
    return formatted.withColumn("turns", parse(F.col("formatted")))


def round_trip_failures(formatted: DataFrame) -> DataFrame:
    """Conversations whose recovered turns are not the source's, or whose string holds anything else."""
    read = read_conversations(formatted).withColumn("__back", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))
    rest = F.length(F.regexp_replace("formatted", _TURN, ""))
    return read.where(~F.col("__back").eqNullSafe(F.col("source")) | (rest != 3)).select("conv_id")


def chat_report(rows: DataFrame) -> DataFrame:
    """The digest per conversation, all of it read back from the formatted strings."""
    # roles and texts of the source are not carried on: the digest needs the strings alone
    read = read_conversations(format_conversations(rows).select("conv_id", "formatted"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.role == "assistant"), lambda t: t.text), "")
    return read.withColumn("__loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def with_conflict_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose two turns are made of control strings."""
    extra = spark.sql(r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
                          FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?(?:INST|ASST|ROLE)\])', '[\\\1\2', 'g')) AS shown,
         length(regexp_replace(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?(?:INST|ASST|ROLE)\])', '[\\\1\2', 'g')) AS role_shown
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(shown + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 12 ELSE 16 + role_shown END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
