"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered list of parts. A visitor flattens each by its
type: text is escaped, an image, audio clip or document becomes a placeholder
in its place, is recorded as an attachment with its reference, and counts the
tokens it expands to. A turn is rendered as

    <s>ROLE\\n[INST] CONTENT [/INST]</s>     or, under the loss mask,
    <s>ROLE\\nCONTENT</s>                    for an assistant

Control strings inside texts get a backslash after their first character (one
more where there are some already), which is undone on reading back.

Defined results: a null text or role is empty; an empty list of parts is an
empty text; parts of an unknown type are attachments of type ``file``; turns
are ordered by number, then role and text, repeated rows being turns of their
own; rows without a conversation id form one conversation; an empty table gives
no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands after the first character of the control strings
# <s> </s> [INST] [/INST] <<SYS>> <</SYS>> <|...|>
_AFTER_ANGLE = r"/?s>|</?SYS>>|\|[a-z_]+\|>"
_AFTER_SQUARE = r"/?INST\]"
CONTROL = rf"(<(?=\\*(?:{_AFTER_ANGLE}))|\[(?=\\*(?:{_AFTER_SQUARE})))"
ESCAPED = rf"(<(?=\\+(?:{_AFTER_ANGLE}))|\[(?=\\+(?:{_AFTER_SQUARE})))\\"
#: Tokens that one unit (tile, second, page) of an attachment expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512, "file": 128}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def text_part(text: Column) -> Column:
    """The list of parts of a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(0).cast("long").alias("units")))


def kind(part: Column) -> Column:
    known = F.coalesce(part["type"], F.lit("text"))
    return F.when(known.isin("text", *TOKENS_PER_UNIT), known).otherwise("file")


def flattened(parts: Column) -> Column:
    """The content: escaped texts and placeholders, in order.

    Texts that follow each other are escaped as one, so no control string comes about where two of them meet."""
    def visit(seen: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), kind(p), F.lit("|>"))
        return F.when(kind(p) == "text", F.struct(seen["done"].alias("done"), F.concat(seen["text"], F.coalesce(p["text"], F.lit(""))).alias("text"))).otherwise(
            F.struct(F.concat(seen["done"], escape(seen["text"]), mark).alias("done"), F.lit("").alias("text")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, visit, lambda seen: F.concat(seen["done"], escape(seen["text"])))


def attachments(parts: Column) -> Column:
    """``part, type, ref, tokens`` of the parts that are no text, in order of their placeholders."""
    rate = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    seen = F.transform(parts, lambda p, i: F.struct(
        i.alias("part"), kind(p).alias("type"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(1)) * rate[kind(p)]).alias("tokens")))
    return F.coalesce(F.filter(seen, lambda p: p["type"] != "text"),
                      F.array().cast("array<struct<part:int,type:string,ref:string,tokens:bigint>>"))


def format_chats(turns: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """One row for each conversation of ``turns(conv_id, turn, role, parts)``.

    Returns ``conv_id, formatted, segments, loss_spans, attachments,
    attachment_tokens``: ``segments(text, loss)`` joined are the formatted text,
    ``loss_spans(start, length)`` are code point ranges of it, and
    ``attachments(turn, part, type, ref, tokens)`` follow the placeholders.
    """
    role = F.coalesce("role", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), flattened(F.col("parts")).alias("content"),
                     attachments(F.col("parts")).alias("attached"))
    learn = F.col("role").isin(*loss_roles)
    t = t.select(
        "*", learn.alias("learn"),
        F.concat(F.lit("<s>"), _escape_role(F.col("role")), F.when(learn, "\n").otherwise("\n[INST] ")).alias("head"),
        F.when(learn, "</s>").otherwise(" [/INST]</s>").alias("tail"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    n = F.char_length("head") + F.char_length("content") + F.char_length("tail")
    t = t.withColumn("nth", F.row_number().over(w)).withColumn(
        "start", F.sum(n.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - n)
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("nth", "turn", "start", "learn", "head", "content", "tail", "attached"))).alias("t"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda x: F.array(
        seg(x["head"], F.lit(False)), seg(x["content"], x["learn"]), seg(x["tail"], F.lit(False)))))
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(
        (x["start"] + F.char_length(x["head"])).alias("start"), F.char_length(x["content"]).cast("long").alias("length")))
    refs = F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(
        x["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return g.select("conv_id", segments.alias("segments"), spans.alias("loss_spans"), refs.alias("attachments")).select(
        "conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "loss_spans", "attachments",
        F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """``role, text`` of the turns of a formatted text; placeholders stay in the text."""
    raw = F.regexp_extract_all(formatted, F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1))
    body = lambda x: F.regexp_replace(
        F.substring(x, F.locate("\n", x) + 1, F.char_length(x)), r"(?s)\A\[INST\] (.*) \[/INST\]\z", "$1")
    return F.transform(raw, lambda x: F.struct(
        _unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(body(x)).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of ``format_chats``."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: The conversation that is added to every table: control strings in both texts.
PROBE = """SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
           (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"""

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(text,
      '<(\\*(?:/?s>|</?SYS>>|\|[a-z_]+\|>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS content
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, content) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(content) + length(role) + CASE role WHEN 'assistant' THEN 8 ELSE 23 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
