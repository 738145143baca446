"""Operator 6: chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable.
A conversation that ends in other turns (or has no assistant turn) also gives one closing example without a
trainable span, so that the output holds every turn.

Template: a turn is ``<|role|>text</s>``.  Inside texts, each control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<|``) gets one backslash after its first character, beside those it already has there, which ``unescape`` takes
out again.  Roles are percent-encoded in ``%``, ``|`` and ``<``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.session import cut_lineage

END = "</s>"
_TAIL = r"(/?s>|/?INST\]|\|)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("|", "%7C"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in (("<", "%3C"), ("|", "%7C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def formatted_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """(conv, piece, start, trainable, closing): one row per turn, its formatted text and where it starts in its conversation
    (code points).  ``trainable`` marks assistant turns, ``closing`` the last turn of a conversation.

    Turns are ordered by turn (nulls first), ties by role and text; repeated rows stay repeated turns.  Null
    texts and roles are empty; a null conversation id is one conversation.  An empty table gives no rows.

    Rows are range-partitioned by (conversation, turn, role), so a conversation that holds a third of all rows lies in many
    tasks.  Starts are running lengths inside a partition plus an offset for conversations that began in an earlier
    one; neighbouring partitions share at most one conversation, so that table has at most two rows a partition."""
    who = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = Window.partitionBy("_pid", "conv").orderBy("turn", "role", "text")
    piece = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>"), escape(F.col("text")), F.lit(END))
    placed = cut_lineage(rows.repartitionByRange(parts, "conv", "turn", "role").withColumn("_pid", F.spark_partition_id())
                         .withColumn("piece", piece).withColumn("chars", F.length("piece").cast("long"))
                         .withColumn("upto", F.sum("chars").over(here.rowsBetween(Window.unboundedPreceding, 0)))
                         .withColumn("last_here", F.lead(F.lit(False), 1, True).over(here))
                         .select("conv", "_pid", "piece", "chars", "upto", "last_here", (F.col("role") == "assistant").alias("trainable")),
                         "formatted_turns")
    conv_parts = Window.partitionBy("conv")
    spread = (placed.groupBy("conv", "_pid").agg(F.sum("chars").alias("_n"))
              .select("conv", "_pid", (F.sum("_n").over(conv_parts.orderBy("_pid")) - F.col("_n")).alias("_off"),
                      (F.max("_pid").over(conv_parts) > F.col("_pid")).alias("_goes_on"))
              .filter("_off > 0 OR _goes_on").withColumnRenamed("conv", "_conv").withColumnRenamed("_pid", "_p"))
    j = placed.join(F.broadcast(spread), (F.col("_pid") == F.col("_p")) & F.col("conv").eqNullSafe(F.col("_conv")), "left")
    return j.select("conv", "piece", (F.coalesce("_off", F.lit(0)) + F.col("upto") - F.col("chars")).alias("start"), "trainable",
                    (F.col("last_here") & ~F.coalesce("_goes_on", F.lit(False))).alias("closing"))


def spans(formatted: DataFrame) -> DataFrame:
    """(conv, piece, start, formatted_chars, loss_start, loss_end): the examples as spans of their conversation's formatted
    text.  An example's text is the first ``formatted_chars`` code points; its last turn is ``piece``, from ``start``.
    Turns that end no example have a null ``formatted_chars``.  Linear in the conversation, unlike the texts."""
    stop = F.col("start") + F.length("piece")
    body = F.col("start") + F.locate("|>", F.col("piece")) + 1
    return formatted.select("conv", "piece", "start", F.when(F.col("trainable") | F.col("closing"), stop).alias("formatted_chars"),
                            F.when(F.col("trainable"), body).alias("loss_start"),
                            F.when(F.col("trainable"), stop - len(END)).alias("loss_end"))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv, example, formatted, loss_start, loss_end): one row per assistant turn, in order, and the closing one.

    ``loss_start``/``loss_end`` are code points of ``formatted``, end exclusive; both null in a closing example.
    Turns are ordered by turn (nulls first), ties by role and text; repeated rows stay repeated turns.  Null
    texts and roles are empty; a null conversation id is one conversation.  An empty table gives no examples.

    The texts grow with the square of a conversation's turns, as the expansion asks; a conversation's text has to fit a
    row.  ``spans`` gives the same examples without repeating their contexts."""
    return expanded(turns, conv, turn, role, text).select("conv", "example", "formatted", "loss_start", "loss_end")


# A share holds some so many examples of a conversation; a conversation has no more than MAX_SHARES shares.
SHARE_EXAMPLES, MAX_SHARES = 1000, 32


def expanded(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``examples`` and ``whole_chars``, the length of the conversation's longest example.

    A conversation's text is gathered once, and every example is its own prefix of it, made row by row, so a task holds
    one example at a time.  The examples of a long conversation are dealt in turn over MAX_SHARES shares, so as many
    tasks expand them."""
    per = (spans(formatted_turns(turns, conv, turn, role, text)).groupBy("conv")
           .agg(F.sort_array(F.collect_list(F.struct("start", "piece", "formatted_chars", "loss_start", "loss_end"))).alias("t"))
           .select("conv", F.array_join("t.piece", "").alias("whole"),
                   F.filter("t", lambda x: x["formatted_chars"].isNotNull()).alias("ends"))
           .select("conv", "whole", F.transform("ends", lambda x, i: F.struct(
               i.cast("long").alias("example"), x["formatted_chars"].alias("stop"), x["loss_start"].alias("loss_start"),
               x["loss_end"].alias("loss_end"))).alias("ends")))
    shares = F.least(F.lit(MAX_SHARES), F.ceil(F.size("ends") / SHARE_EXAMPLES)).cast("int")
    dealt = (per.withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
             .select("conv", "whole", "share", F.expr("filter(ends, (x, i) -> i % shares = share)").alias("ends"))
             .repartition("conv", "share"))
    return dealt.select("conv", "whole", F.explode("ends").alias("e")).select(
        "conv", "e.example", F.substr("whole", F.lit(1), F.col("e.stop").cast("int")).alias("formatted"), "e.loss_start", "e.loss_end",
        F.length("whole").cast("long").alias("whole_chars"))


def read_back(ex: DataFrame) -> DataFrame:
    """What the formatted examples hold, per conversation: ``turns`` (role, text), parsed from the longest
    example; ``loss``, the unescaped text under every example's loss mask in order; all formatted characters."""
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.expr(
        "substring(formatted, int(loss_start) + 1, int(loss_end - loss_start))")))
    per = (ex.select("conv", "example", "formatted", masked.alias("loss")).groupBy("conv")
           .agg(F.max_by("formatted", "example").alias("whole"), F.sum(F.length("formatted")).alias("formatted_chars"),
                F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses")))
    pieces = F.split("whole", END)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape_role(F.substring_index(F.substr(p, F.lit(3)), "|>", 1)).alias("role"),
        unescape(F.substr(p, F.locate("|>", p) + 2)).alias("text")))
    return per.select("conv", turns.alias("turns"), "formatted_chars", F.array_join(F.transform(
        F.filter("losses", lambda x: x["loss"].isNotNull()), lambda x: x["loss"]), "").alias("loss"))


def with_control_case(spark, conversations: DataFrame) -> DataFrame:
    case = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
                        (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(case)


def contract(spark, conversations: DataFrame) -> DataFrame:
    """The digests, read back from the examples' own texts: lengths and masked texts from each, the turns from the longest
    (parsed after its conversation's other examples were left behind, so a shuffle carries a conversation's text once)."""
    ex = expanded(with_control_case(spark, conversations))
    masked = unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    chars = F.length("formatted").cast("long")
    read = ex.select("conv", "example", chars.alias("chars"), F.coalesce(masked, F.lit("")).alias("loss"),
                     F.when(chars == F.col("whole_chars"), F.col("formatted")).alias("whole"))
    per = read.groupBy("conv").agg(F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"),
                                   F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("t"))
    pieces = F.split("whole", END)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.concat(
        unescape_role(F.substring_index(F.substr(p, F.lit(3)), "|>", 1)), F.lit("\n"),
        unescape(F.substr(p, F.locate("|>", p) + 2)), F.lit("\n")))
    loss = F.array_join("t.loss", "")
    return per.select(F.col("conv").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
                      F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
           FROM range(2) r(i)),
u AS (SELECT *, length('<|' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C') || '|>'
             || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g') || '</s>') AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM t),
v AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY from_end DESC) AS upto FROM u)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY from_end DESC)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY from_end DESC) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM v GROUP BY conv_id
"""
