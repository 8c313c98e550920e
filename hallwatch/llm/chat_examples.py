"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes its own example: all preceding turns as context and that reply as the only trainable text.
A conversation that ends with another role gives one more example without a target, so that no turn is lost. A turn is
written as ``<|role|>``, a newline, the text, ``<|end|>`` and a newline. Inside roles and texts ``&``, ``<`` and ``>``
become entities, so nothing in them can look like a mark, and reading back undoes exactly that.

An example is one training sequence and so one row; a conversation is grouped as the example needs it whole.

Defined results: a null text or role is empty; turns sort by number, then role, then text (null numbers first); rows
without a conversation id are a conversation each (``part`` numbers them); repeated rows are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

END = "<|end|>\n"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(c: Column) -> Column:
    for plain, coded in _ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(_ENTITIES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """``conv_id, part`` (0, a number of its own for a null id)``, position`` (of the last turn in it, from 1), ``last, text, loss_start`` (from 1), ``loss_chars``."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                                 F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("part"))
    whole = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", "part", F.size("turns").alias("n"), F.transform("turns", lambda t: t["role"] == "assistant").alias("trained"),
                         F.transform("turns", lambda t: head(t["role"])).alias("heads"), F.transform("turns", lambda t: escape(t["text"])).alias("bodies"))
    whole = whole.withColumn("parts", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))))
    at = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("trained", i - 1) | (i == F.col("n")))
    rows = whole.select("conv_id", "part", "n", "parts", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("position"), F.get("trained", i - 1).alias("trained"), F.length(F.get("heads", i - 1)).alias("head"), F.length(F.get("bodies", i - 1)).alias("body")))).alias("x"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("x.position") - 1), "")
    rows = rows.select("conv_id", "part", "x.position", (F.col("x.position") == F.col("n")).alias("last"), context.alias("context"), F.get("parts", F.col("x.position") - 1).alias("reply"), "x.trained", "x.head", "x.body")
    return rows.select("conv_id", "part", "position", "last", F.concat("context", "reply").alias("text"), (F.length("context") + F.col("head") + 1).alias("loss_start"),
                       F.when(F.col("trained"), F.col("body")).otherwise(0).alias("loss_chars"))


def read_turns(text: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted example."""
    parts = F.split(text, r"<\|end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        marked = F.substring_index(part, "|>\n", 1)
        return F.struct(unescape(F.substr(marked, F.lit(3))).alias("role"), unescape(F.substr(part, F.length(marked) + 4)).alias("text"))
    return F.transform(parts, turn)


def read_loss(examples: DataFrame) -> Column:
    """The trainable text of each example as the conversation had it."""
    return unescape(F.substr("text", F.col("loss_start"), F.col("loss_chars")))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    examples = prefix_targets(rows.unionByName(extra))
    said = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select("conv_id", "part", "position", F.length("text").alias("chars"), read_loss(examples).alias("loss"), F.when(F.col("last"), said).alias("said"))
    whole = read.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("position", "loss"))).alias("losses"), F.flatten(F.collect_list("said")).alias("said"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return whole.select("conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(F.array_join("said", "").cast("binary"), 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS part, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 0, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 13 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
               + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS chars,
         row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id, part) AS n FROM rows_),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, part ORDER BY place) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id, part"""
