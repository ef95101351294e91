"""Chat formatting with typed content parts, an escaping template and a loss mask (DataFrame functions only).

A message's content is an array of typed parts. ``flatten_parts`` visits them in order: text is escaped, an image,
audio or document part becomes an ordered placeholder ``<|kind:k|>``; its reference and the number of tokens it
expands to are recorded. ``format_chat`` joins the turns of a conversation into one string and records where each
trained (assistant) text lies. ``read_back`` parses that string alone.

Escaping is reversible: a backslash is doubled, then each control string gets a backslash after its first
character, so no control string is left inside a text and an odd backslash there can only be the escape's.

Defined cases: null text or parts read as empty, null role as an empty role; a null conv_id is a conversation of
its own; equal turns are ordered by role and text, repeated rows stay as repeated turns; an empty table gives an
empty result; further columns are ignored, whatever their names. A conversation becomes one string by
definition, so its turns meet in one row; conversations are spread over the cluster by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: marks of this template and control strings of common chat templates, all escaped inside texts
TURN, END = "<|turn|>", "<|end|>\n"
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED_ROLE = "assistant"
#: tokens per part: an image counts its patches of PATCH pixels, audio and documents a rate
PATCH, AUDIO_TOKENS_PER_SECOND, DOCUMENT_TOKENS_PER_PAGE = 14, 25, 512
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column, controls: list[str] = CONTROLS) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column, controls: list[str] = CONTROLS) -> Column:
    out = text
    for c in reversed(controls):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # pairs of backslashes first, so that the rest of each piece can only hold single ones
    halves = F.split(role, r"\\\\", -1)
    text = F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\\\")
    return unescape(text)


def expanded_tokens(part: Column) -> Column:
    """Tokens that a non-text part stands for; unknown sizes count as one token."""
    one = F.lit(1).cast("long")
    patches = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    return (F.when(part["type"] == "image", F.coalesce(patches, one))
            .when(part["type"] == "audio", F.coalesce(F.ceil(part["seconds"] * F.lit(AUDIO_TOKENS_PER_SECOND)), one))
            .when(part["type"] == "document", F.coalesce(part["pages"].cast("long") * F.lit(DOCUMENT_TOKENS_PER_PAGE), one))
            .otherwise(F.lit(0).cast("long")))


def flatten_parts(parts: Column) -> Column:
    """struct(body, attachments): the escaped body with ordered placeholders, and what each placeholder stands for.

    A part of another type than text, image, audio or document is read as text.
    """
    parts = F.filter(F.coalesce(parts, F.expr(f"cast(array() as {PART_TYPE})")), lambda p: p.isNotNull())
    media = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + F.lit(1)), media))
    mark = lambda p, i: F.concat(F.lit("<|"), p["type"], F.lit(":"), number(i).cast("string"), F.lit("|>"))
    body = F.array_join(F.transform(parts, lambda p, i: F.when(media(p), mark(p, i)).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    found = F.filter(F.transform(parts, lambda p, i: F.when(media(p), F.struct(
        number(i).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), mark(p, i).alias("placeholder"),
        expanded_tokens(p).alias("tokens")))), lambda x: x.isNotNull())
    return F.struct(body.alias("body"), found.alias("attachments"))


def text_part(text: Column) -> Column:
    """A message that is plain text, as parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_chat(turns: DataFrame, parts_col: str = "parts") -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens) from rows (conv_id, turn, role, parts).

    ``loss_spans`` holds start and length (code points) of each trained text in ``formatted``.
    """
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten_parts(F.col(parts_col)).alias("flat"))
    row = flat.select("conv_id", F.struct("turn", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments")).alias("t"))
    conv = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n"))
    pieces = conv.withColumn("pieces", F.transform("ts", lambda t: F.struct(
        t["role"].alias("role"), F.concat(head(t), t["body"], F.lit(END)).alias("s"),
        F.length(head(t)).alias("before"), F.length(t["body"]).alias("len"))))
    size = lambda p: p["before"] + p["len"] + F.lit(len(END))
    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    spans = F.aggregate("pieces", start, lambda a, p: F.struct(
        (a["pos"] + size(p)).alias("pos"),
        F.when(p["role"] == TRAINED_ROLE, F.concat(a["spans"], F.array(F.struct((a["pos"] + p["before"]).alias("start"), p["len"].alias("length")))))
        .otherwise(a["spans"]).alias("spans")))
    files = F.flatten(F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda x: F.struct(
        i.alias("turn_index"), x["number"].alias("number"), x["type"].alias("type"), x["ref"].alias("ref"),
        x["placeholder"].alias("placeholder"), x["tokens"].alias("tokens")))))
    return pieces.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.size("pieces").cast("long").alias("n_turns"), spans["spans"].alias("loss_spans"), files.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that the formatted string holds, unescaped."""
    split = F.split(formatted, r"<\|turn\|>", -1)
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)
    text = lambda p: F.substring(p, F.instr(p, "\n") + F.lit(1), F.length(p) - F.instr(p, "\n") - F.lit(len(END)))
    return F.transform(pieces, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(text(p)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All trained text: the spans cut out of the formatted string, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + F.lit(1), s["length"]))), "")


def op1(spark, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], own.schema)
    turns = own.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    out = format_chat(turns).withColumn("back", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + 1 + len(END)} + length(replace({_sql_escape('role')}, chr(10), '\\n')) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
