r"""Chat formatting with a grammar that is read back.

A conversation is a header line and its turns: ``### role: text</turn>`` and a line end each. First the turns are written as they
are, under the header ``<chat>``; a deterministic parser reads the result, and if the turns that it recovers differ from the source
(a text holds ``</turn>``, a role a colon), the conversation is written again under ``<chat escaped>``, with a backslash before each
backslash and control string. The parser takes the whole text or nothing. All expressions are built-in functions.

Defined results: null roles and texts are empty; turns come by turn (null first), then role, then text; repeated rows are turns of
their own; a null conv_id is a conversation; an empty table gives none. A formatted conversation is one value of the result, so one
conversation's turns meet in one task; turns are gathered in parts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

PLAIN, ESCAPED = "<chat>\n", "<chat escaped>\n"
_PLAIN_TURN = r"(?s)### ([^:\n]*+): ((?:[^<]++|<(?!/turn>))*+)</turn>\n"
_ESCAPED_TURN = r"(?s)### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|</turn>|### ", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\:<#\n]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _written(turns: Column, escaped: bool) -> Column:
    role, text = (escape_role, escape) if escaped else (lambda c: c, lambda c: c)
    each = F.transform(turns, lambda t: F.concat(F.lit("### "), role(t["role"]), F.lit(": "), text(t["text"]), F.lit("</turn>\n")))
    return F.concat(F.lit(ESCAPED if escaped else PLAIN), F.array_join(each, ""))


def parse(formatted: Column, places: bool = True) -> Column:
    """The turns as (role, text, and with places start and end of the text as it is written), or null if the whole isn't a conversation."""

    def read(turn: str, header: str, back) -> Column:
        def put(state: Column, x: Column) -> Column:
            start = state["at"] + 4 + F.length(x["r"]) + 2
            end = start + F.length(x["b"])
            row = F.struct(back(x["r"]).alias("role"), back(x["b"]).alias("text"), start.alias("start"), end.alias("end"))
            return F.struct((end + len("</turn>\n")).alias("at"), F.array_append(state["turns"], row).alias("turns"))

        def turns(got: Column) -> Column:
            if not places:
                return F.transform(got, lambda x: F.struct(back(x["r"]).alias("role"), back(x["b"]).alias("text")))
            none = F.array().cast("array<struct<role:string,text:string,start:int,end:int>>")
            return F.aggregate(got, F.struct(F.lit(len(header)).alias("at"), none.alias("turns")), put, lambda s: s["turns"])

        # what lies between turns is in none of them, so only then do their lengths add up
        length = lambda got: F.aggregate(got, F.lit(len(header)), lambda s, x: s + F.length(x["r"]) + F.length(x["b"]) + len("### : </turn>\n"))
        found = F.zip_with(F.regexp_extract_all(formatted, F.lit(turn), F.lit(1)), F.regexp_extract_all(formatted, F.lit(turn), F.lit(2)), lambda r, b: F.struct(r.alias("r"), b.alias("b")))
        return let(found, lambda got: F.when(length(got) == F.length(formatted), turns(got)))

    return F.when(formatted.startswith(PLAIN), read(_PLAIN_TURN, PLAIN, lambda c: c)).when(formatted.startswith(ESCAPED), read(_ESCAPED_TURN, ESCAPED, unescape))


def _same(recovered: Column, source: Column) -> Column:
    plain = F.transform(recovered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(plain == F.transform(source, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, formatted, turns (as recovered from it), loss_spans (start and end of each assistant text in it)."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.select(F.col(id_col).alias("_id"), row.alias("_row")).groupBy("_id").agg(F.sort_array(F.collect_list("_row")).alias("_turns"))
    first = grouped.withColumn("_plain", _written(F.col("_turns"), False))
    text = F.when(_same(parse(F.col("_plain"), places=False), F.col("_turns")), F.col("_plain")).otherwise(_written(F.col("_turns"), True))
    read = first.select("_id", "_turns", text.alias("formatted")).withColumn("turns", parse(F.col("formatted")))
    # the grammar rules this out; if it ever failed, nothing false may be written
    checked = F.when(_same(F.col("turns"), F.col("_turns")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation can't be read back")))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return read.withColumn("turns", checked).select(F.col("_id").alias(id_col), "formatted", "turns", mask.alias("loss_spans"))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more))
    under = F.transform("loss_spans", lambda s: F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))
    plain = F.col("formatted").startswith(PLAIN)
    loss = F.array_join(F.transform(under, lambda t: F.when(plain, t).otherwise(unescape(t))), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         bool_or(contains(text, '</turn>') OR regexp_matches(role, '[:\n]')) AS escaped,
         sum(14 + len(role) + len(text)) AS plain,
         sum(len(regexp_extract_all(role, '[\\:<#\n]')) + len(regexp_extract_all(text, '\\|</turn>|### '))) AS more
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(CASE WHEN escaped THEN 15 + plain + more ELSE 7 + plain END AS BIGINT) AS formatted_chars FROM c
"""
