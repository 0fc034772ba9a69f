"""Language identification by compression.

Every language has a raw-content zstandard dictionary of its own text. A text's words, in lower case and without digits and marks, are cut into blocks of ``BLOCK`` bytes, each block is compressed with every dictionary, and the language with the smallest sum wins: the dictionary that shares most with the text makes it shortest. Blocks keep a long text from becoming its own dictionary. The margin is the second-smallest size less the smallest, as a part of the smallest; a text whose margin is below ``min_margin`` is rejected, and so is one without letters.

The dictionaries are fitted on a bounded sample of labelled rows: rows are drawn by a hash of the id at a rate that gives about ``sample_rows`` a language, repeated texts are taken once, and in order of a hash of the text they fill ``dictionary_bytes`` a language, the last of them up to where the dictionary is full. Everything else covers all rows and whole texts.

Defined cases: a null text, and one without a letter, is ``und`` with score 0 and not accepted; rows without a language teach nothing; ties go to the language that sorts first; with no labelled rows every text is ``und``; with one language its margin is 1; a kept column named as an output is named ``<name>_kept``. Only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

UNKNOWN, BLOCK, LEVEL = "und", 1_024, 3
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text's words in lower case, one space between: case, digits and marks say little of a language."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


@dataclass
class Model:
    dictionaries: dict[str, bytes]
    min_margin: float
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "min_margin": self.min_margin, "_ready": []}

    def compressors(self):
        import zstandard as z

        if not self._ready:
            for lang in sorted(self.dictionaries):
                d = z.ZstdCompressionDict(self.dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._ready.append((lang, z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return self._ready


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1_600, dictionary_bytes: int = 112_640, min_margin: float = 0.002) -> Model:
    """A dictionary for every value of ``lang_col``. The driver gets at most ``dictionary_bytes`` a language."""
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and text <> ''")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Model({}, min_margin)
    rate = F.lit(1.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / n))).otherwise(rate)
    drawn = rows.where((F.col("h").bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(1 << 31))) < rate)
    once = drawn.groupBy("lang", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"))
    size = dictionary_bytes

    def fill(pdf):
        taken, n = [], 0
        for text in pdf.sort_values("key")["text"]:
            raw = letters(text)[: size - n]
            taken.append(raw)
            n += len(raw)
            if n >= size:
                break
        import pandas as pd

        # the end of a dictionary is the cheapest to refer to: the first texts drawn go last
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "raw": [b"\n".join(reversed(taken))]})

    found = once.groupBy("lang").applyInPandas(fill, "lang string, raw binary").collect()
    return Model({r.lang: bytes(r.raw) for r in found}, min_margin)


def classify(text: str | None, model: Model) -> tuple[str, float, float, bool]:
    """(language, score, margin, accepted)."""
    if not text or not model.dictionaries or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, False
    raw = letters(text)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
        tail = blocks.pop()
        blocks[-1] += tail
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in model.compressors())
    best, lang = sizes[0]
    if len(sizes) == 1:
        return lang, 1.0, 1.0, True
    margin = (sizes[1][0] - best) / best
    # sizes are negative log-likelihoods in bytes; a tempered soft minimum makes a score of them
    weights = np.exp(-np.array([n - best for n, _ in sizes]) * min(1.0, 64 / best))
    return lang, float(1 / weights.sum()), margin, margin >= model.min_margin


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its id, the columns of ``keep``, lang_pred, score (0 to 1), margin and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of():
        m = held.value
        return lambda texts: zip(*(classify(t, m) for t in texts), strict=True) if texts else ((),) * 4

    outputs = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "margin": ("double", pa.float64()), "accepted": ("boolean", pa.bool_())}
    return common.text_columns(docs, text_col, (id_col, *keep), outputs, of)
