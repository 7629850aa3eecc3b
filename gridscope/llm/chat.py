r"""Chat formatting with a reversible escape, checked by a grammar round trip.

Grammar (control strings never occur inside ROLE or TEXT of rendered output):

    conversation := turn*
    turn         := "<s>[INST] " ROLE " [/INST] " TEXT "</s>"

An escaped string has every backslash doubled and a backslash after the first
character of every control string; unescaping drops each backslash and keeps what
follows it.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(turn: Column, part: str) -> Column:
    """ROLE or TEXT of one rendered turn without its close, unescaped; null if it isn't a turn."""
    body = F.substr(turn, F.lit(len(OPEN) + 1))
    middle = F.instr(body, F.lit(MIDDLE))
    got = F.substr(body, F.lit(1), middle - 1) if part == "role" else F.substr(body, middle + len(MIDDLE))
    return F.when(F.startswith(turn, F.lit(OPEN)) & (middle > 0), unescape(got))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation: a deterministic split at the closes."""
    parts = F.split(formatted, r"\Q" + CLOSE + r"\E", -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    return F.transform(turns, lambda t: F.struct(_piece(t, "role").alias("role"), _piece(t, "text").alias("text")))


def _settled(text: Column) -> Column:
    """The text as rendered: as it is if its turn reparses to it and holds no control string, else escaped."""
    back = F.element_at(parse(F.concat(F.lit(OPEN + "r" + MIDDLE), text, F.lit(CLOSE))), 1)["text"]
    same = F.coalesce(back == text, F.lit(False))
    for c in CONTROLS:
        same = same & ~F.contains(text, F.lit(c))
    return F.when(same, text).otherwise(escape(text))


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant"
) -> DataFrame:
    """One row per conversation: (conv_id, formatted, mask, turns).

    Turns go by number (null first; ties by role, then text); null roles and texts are
    empty.  mask has (start, length), in code points from 1, of every learner text in the
    formatted string, as rendered; turns are the source's (role, text).  A
    conversation's rows meet in one task, as its one formatted string must.  A null
    conv_id is a conversation; repeated rows are repeated turns; other columns are
    ignored; an empty table gives an empty result.
    """
    src = rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    src = src.withColumn("head", F.concat(F.lit(OPEN), _settled(F.col("role")), F.lit(MIDDLE))).withColumn("body", _settled(F.col("text")))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    length = F.length("head") + F.length("body") + len(CLOSE)
    w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumn("start", F.sum(length).over(w) - F.length("body") - len(CLOSE) + 1).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    got = F.sort_array(F.collect_list(F.struct("n", "role", "text", "head", "body", "start")))
    return src.groupBy("conv_id").agg(got.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda t: t["role"] == learner),
            lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length")),
        ).alias("mask"),
        F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, round_trip), all from formatted and mask."""
    turns = parse(F.col("formatted"))
    under = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"].cast("int"), m["length"].cast("int"))))
    parsed = chats.select("conv_id", "formatted", turns.alias("got"), F.array_join(under, "").alias("loss"), "turns")
    said = F.array_join(F.transform("got", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("got").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        (F.col("got") == F.col("turns")).alias("round_trip"),
    )


def _sql_settled(x: str) -> str:
    out = rf"replace({x}, '\', '\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + length({_sql_settled('role')}) + length({_sql_settled('text')}))::BIGINT AS formatted_chars,
  true AS round_trip
FROM src GROUP BY conv_id
"""
