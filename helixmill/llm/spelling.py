"""Spelling variants without pairs: words meet in groups that share all but one letter, and each group hands every member only how many others it holds and the most frequent of them.

A word of L letters is in L wildcard groups (position, prefix, suffix), one a replaced letter, in the groups of its deletions, and in that of itself. A wildcard group keeps its size and its two most frequent words, so that each member finds the best other one. A deletion that is itself a word is near the word it came from: the group of a string counts the words that have it as a deletion, and tells them whether it is a word. So a group of m words costs m rows, never m squared, and each word sums over its groups.

Words are counted in the tasks that read the texts, which hand on partial counts; only words with enough occurrences are grouped.

Defined cases: null texts have no words; a null id counts as an empty one; the same text under many ids counts each time; equal counts go to the smaller word in code-point order. Texts are read whole, in stretches cut between runs. Columns besides the two named are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common

#: Letters of a run; only A to Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WILD = "*"
#: One in so many (document, word) pairs loses a letter, which plants variants.
SLIP = 199
#: Words that a task holds before it hands on their counts, and bytes of a text that are read at a time.
HELD, STRETCH = 200_000, 4_000_000

_RUN, _GAP = re.compile(RUN), re.compile("[^A-Za-zÀ-ÿ]")


def runs(text: bytes):
    """Lists of the lower-cased runs of a UTF-8 text; a long one in stretches cut between two runs."""
    text = text.translate(LOWER).decode()
    at = 0
    while len(text) - at > STRETCH:
        cut = _GAP.search(text, at + STRETCH)
        if not cut:
            break
        yield _RUN.findall(text[at : cut.start()])
        at = cut.start()
    yield _RUN.findall(text[at:] if at else text)


def word_counts(docs: DataFrame, least_length: int = 6, slip: int = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points. Where ``slip`` divides the crc32 of "id:run", that document's run loses one letter."""

    def count(batches):
        common.worker_state("spelling", dict)  # gives up what other operators keep
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in common.slices(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                own: Counter = Counter()
                for found in runs(text):
                    own.update(found)
                for word, n in own.items():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word.encode(), begin)
                    if h % slip == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of those of ``words`` (word, n; each once) that have a near word: how many they have, and the most frequent one (of equal ones the smallest)."""
    cut = "concat(substring(word, 1, i - 1), '{}', substring(word, i + 1, length(word)))"
    letters = "sequence(1, length(word))"
    wild = F.expr(f"transform({letters}, i -> named_struct('kind', 0, 'key', {cut.format(WILD)}))")
    shorter = F.expr(f"transform(array_distinct(transform({letters}, i -> {cut.format('')})), d -> named_struct('kind', 1, 'key', d))")
    itself = F.expr("array(named_struct('kind', 2, 'key', word))")
    rows = words.where("length(word) > 0").select("word", "n", F.explode(F.concat(wild, shorter, itself)).alias("at")).select("at.key", "at.kind", "word", "n")
    group = Window.partitionBy("key").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("neg"), "word")
    told = rows.select("*", F.count("*").over(group).alias("size"), F.first(me).over(group).alias("first"), F.nth_value(me, 2).over(group).alias("second"), F.max(F.when(F.col("kind") == 2, me)).over(group).alias("own"))
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    shares = told.where("size > 1 and (kind <> 1 or own is not null)").select("word", F.when(F.col("kind") == 1, 1).otherwise(F.col("size") - 1).alias("m"), F.when(F.col("kind") == 1, F.col("own")).otherwise(other).alias("best"))
    return shares.groupBy("word").agg(F.sum("m").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", (-F.col("best.neg")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form), following forms to the last. Counts grow ``times`` fold a step, up to ``most``, so doubling the steps so many rounds reaches every end."""
    steps = max(1.0, math.log(max(most, 1)) / math.log(times))
    spark = forms.sparkSession
    path = common.new_path(spark, "roots")
    at = common.stage(forms.select("word", F.col("form").alias("root")), "roots", path)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on, before, path = at.select(F.col("word").alias("next"), F.col("root").alias("further")), path, common.new_path(spark, "roots")
        at = common.stage(at.join(on, F.col("root") == F.col("next"), "left").select("word", F.coalesce("further", "root").alias("root")), "roots", path)
        common.remove(spark, before)
    return at


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, slip: int = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word of at least ``least_length`` letters and ``least_count`` occurrences: word, n, n_near, form (its most frequent near word, if that occurs at least ``times`` as often), form_n, root (from the word, forms followed to the last)."""
    if times < 2:
        raise ValueError("a form has to be at least twice as frequent")
    words = common.stage(word_counts(docs, least_length, slip, id_col, text_col).where(F.col("n") >= least_count), "words")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    near = common.stage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0] or 0
    return near.join(roots(near.where("form is not null"), most // least_count, times), "word", "left").withColumn("root", F.coalesce("root", "word"))
