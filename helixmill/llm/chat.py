"""Chat formatting by relational means: turns are gathered as structs, sorted, merged with their neighbours of the same role and written in a template, by Spark expressions alone.

A conversation is formatted in pieces: its turns numbered 256 k to 256 k + 255 are one, so no task gathers more than a stretch of a conversation, however long. Stretches that hold over ``PIECE_ROWS`` rows or ``PIECE_BYTES`` bytes, as turn numbers repeat or texts are long, are cut further by ranges of (turn, role, beginning of the text). A piece's string goes on where that of the piece before ended, inside a block too.

The template is ChatML with a mark between the texts of one block. Control strings inside texts and roles, those of other common templates too, get a backslash after their first character; backslashes already there are kept, one more is added, and reading takes one away. So no text can end its turn or open another one, and every text is read back as it was.

Defined cases: null texts and roles count as empty. Rows are ordered by turn (null first), then role, then text; rows that agree in all are all kept. Each row is a turn of its own, although adjacent turns of one role share a block. A null conversation id is one conversation. Empty tables give no rows. Columns besides the four named are not read. Texts of any length are formatted whole, up to the 2 GB of a Spark value a piece; rows that agree in conversation, turn, role and the first 256 characters meet in one piece.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common

#: Turn numbers of a piece, as a power of two; rows and bytes from which one is cut further.
PIECE_BITS, PIECE_ROWS, PIECE_BYTES = 8, 1_024, 64_000_000
PREFIX = 256


@dataclass(frozen=True)
class Template:
    """Marks: ``start`` role newline text (``joint`` text)* ``end``, block after block. ``reserved``: control strings of other templates, escaped too."""

    start: str = "<|im_start|>"
    joint: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")

    def pattern(self, escapes: str) -> str:
        """The first character of a control string and what stands between it and the rest."""
        marks = (self.start, self.joint, self.end, *self.reserved)
        firsts, rests = sorted({re.escape(x[0]) for x in marks}), sorted({re.escape(x[1:]) for x in marks})
        return f"([{''.join(firsts)}]){escapes}(?={'|'.join(rests)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(r"(\\*)"), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(r"\\(\\*)"), "$1$2")

    def role(self, role: Column) -> Column:
        """A role on one line."""
        return self.escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))

    def unrole(self, role: Column) -> Column:
        return F.replace(F.replace(self.unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


CHATML = Template()


def stretches(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows with the piece they belong to: stretch, never null; (bucket, sub) orders those of a conversation."""
    turn = F.col(turn_col).cast("bigint")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"), F.coalesce(F.shiftright(turn, PIECE_BITS), F.lit(-(2**63)).cast("bigint")).alias("bucket"))
    rows = rows.withColumn("stretch", F.concat(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")), F.lit("/"), F.col("bucket").cast("string")))
    sized = rows.groupBy("stretch").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    crowded = common.stage(sized.where((F.col("n") > PIECE_ROWS) | ((F.col("bytes") > PIECE_BYTES) & (F.col("n") > 1))), "crowded")
    total = crowded.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    if not total.n:
        return rows.withColumn("sub", F.lit(0))
    told = common.join_repeated(rows, crowded.select("stretch", "n", F.lit(True).alias("crowded")), "stretch")
    parts = 1 + max(4 * total.n // PIECE_ROWS, 4 * total.bytes // PIECE_BYTES)
    dense = told.where("crowded").repartitionByRange(int(parts), "conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, PREFIX))
    dense = common.stage(dense.drop("crowded").withColumn("sub", F.spark_partition_id() + 1).withColumn("stretch", F.concat("stretch", F.lit("/"), F.col("sub").cast("string"))), "dense")
    return told.where("crowded is null").drop("crowded").withColumn("sub", F.lit(0)).unionByName(dense)


def format_conversations(turns: DataFrame, template: Template = CHATML, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per piece of a conversation: conv_id, piece (from 0), pieces, formatted, and loss, the spans (start, length in code points of ``formatted``) of texts whose role is in ``learn``.

    A conversation's string is that of its pieces in order (``whole``); nearly all conversations are one piece. Texts are shuffled once, by piece; how pieces follow each other is worked out from rows without texts.
    """
    rows = stretches(turns, conv_col, turn_col, role_col, text_col)
    order = Window.partitionBy("conv_id").orderBy("bucket", "sub")
    ends = rows.groupBy("stretch", "conv_id", "bucket", "sub").agg(F.max(F.struct("turn", "role"))["role"].alias("last"))
    ends = ends.select("stretch", F.lag("last").over(order).alias("before"), (F.row_number().over(order) - 1).alias("piece"), F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("pieces")).where("pieces > 1")
    gathered = rows.groupBy("stretch").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    placed = gathered.join(ends, "stretch", "left").select("conv_id", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("pieces", F.lit(1)).alias("pieces"), "before", "turns")

    bodies = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), template.escape(t["text"]).alias("body"), t["role"].isin(*learn).alias("learned")))
    start = F.struct(F.col("before").alias("role"), F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def add(done: Column, t: Column) -> Column:
        opened = F.concat(F.lit(template.start), template.role(t["role"]), F.lit("\n"))
        closed = F.when(done["role"].isNull(), opened).otherwise(F.concat(F.lit(template.end + "\n"), opened))
        mark = F.when(done["role"] == t["role"], template.joint).otherwise(closed)
        begin = done["at"] + F.length(mark)
        span = F.struct(begin.alias("start"), F.length(t["body"]).alias("length"))
        return F.struct(t["role"].alias("role"), F.concat(done["parts"], F.array(mark, t["body"])).alias("parts"), (begin + F.length(t["body"])).alias("at"), F.when(t["learned"], F.concat(done["loss"], F.array(span))).otherwise(done["loss"]).alias("loss"))

    merged = placed.select("conv_id", "piece", "pieces", F.aggregate(bodies, start, add).alias("m"))
    last = F.when(F.col("piece") == F.col("pieces") - 1, template.end + "\n").otherwise("")
    return merged.select("conv_id", "piece", "pieces", F.concat(F.array_join("m.parts", ""), last).alias("formatted"), F.col("m.loss").alias("loss"))


def learned(pieces: DataFrame, template: Template = CHATML) -> DataFrame:
    """``pieces`` with ``learned``, all text under their loss mask."""
    spans = F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return pieces.withColumn("learned", F.array_join(spans, ""))


def whole(pieces: DataFrame, *columns: str) -> DataFrame:
    """One row a conversation with the strings ``columns`` of its pieces put together. Conversations of one piece stay where they are; others meet in a task each, as one value is asked for."""
    single = pieces.where("pieces = 1").select("conv_id", *columns)
    listed = pieces.where("pieces > 1").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", *columns))).alias("p"))
    return single.unionByName(listed.select("conv_id", *[F.array_join(F.col(f"p.{c}"), "").alias(c) for c in columns]))


def parsed(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a whole conversation's string, as an array."""
    close = len(template.end) + 1

    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - close)
        return F.transform(F.split(body, re.escape(template.joint)), lambda t: F.struct(template.unrole(role).alias("role"), template.unescape(t).alias("text")))

    blocks = F.split(formatted, re.escape(template.start))
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), block))
