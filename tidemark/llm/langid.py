"""Language identification by compression.

One zstandard raw-content dictionary is cut for each language from a bounded sample of labelled
documents. A text, reduced to lower-case letters and single blanks, is compressed whole, in blocks,
with every dictionary; the smallest total wins. Equal totals go to the language with more training
documents. A narrow margin between the two smallest totals, under NARROW of the larger or under one byte,
is a rejection, at every size of text.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; so is every text
if no document is labelled. Languages are the non-null labels; with one language nothing but ``und`` is
rejected. Texts of any length are compressed whole; an empty table gives no rows; repeated rows and extra
columns are harmless.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Labelled documents sampled for each language, and code points taken from each: the fit's bounds.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 2000
DICT_BYTES, BLOCK_BYTES, LEVEL = 65536, 4096, 5
#: Margins under this share, or under the coder's step of a byte, are narrow.
NARROW = 0.01
UND = "und"
_OTHER = re.compile(rb"[^a-z\x80-\xff]+")


def letters(text: str) -> bytes:
    return _OTHER.sub(b" ", text.lower().encode("utf-8", "replace")).strip()


def fit(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training documents."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted(((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    if not counts:
        return []
    steps = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))
    below = F.lit(0)
    for lang, n in counts:
        below = F.when(F.col("lang") == lang, F.lit(min(steps, -(-2 * sample_docs * steps // n)))).otherwise(below)
    start = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - sample_chars, F.lit(1))) + 1
    part = F.substring(F.col("text"), start.cast("int"), F.lit(sample_chars))
    picked = rows.select("lang", draw.alias("draw"), part.alias("part")).where(F.col("draw") < below)
    found = defaultdict(list)
    for r in picked.orderBy("draw", "part").limit(8 * sample_docs * len(counts)).collect():
        found[r["lang"]].append((r["draw"], r["part"]))
    out = []
    for lang, _ in counts:
        parts = [letters(p) for _, p in sorted(found[lang])[:sample_docs]]
        share = max(1, DICT_BYTES // max(1, len(parts)))
        spare = DICT_BYTES - sum(min(share, len(p)) for p in parts)
        body = b" ".join(p[: share + spare] for p in parts)[-DICT_BYTES:]
        out.append((lang, body or b" "))
    return out


def _coder(body: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters.from_level(
        LEVEL, source_size=BLOCK_BYTES, dict_size=DICT_BYTES, write_content_size=False, format=zstd.FORMAT_ZSTD1_MAGICLESS
    )
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in model]
        self.coders = [_coder(body) for _, body in model]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin in 0..1, and whether it is rejected."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        raw = letters(text)
        blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, max(1, len(raw)), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        apart = second - sizes[best]
        return self.langs[best], apart / second, apart < max(1, NARROW * second)


def classify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """Every column of docs and lang_pred, score, rejected (which replace columns so named). The model's size is bounded by the languages."""
    docs = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("rejected", F.lit(False)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(sent.value)
        for batch in batches:
            table = pa.table(batch) if not isinstance(batch, pa.Table) else batch
            got = [known.classify(x) for x in table.column(text).to_pylist()]
            for k, (name, kind) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()))):
                table = table.append_column(name, pa.array([g[k] for g in got], kind))
            yield from table.to_batches()
            del table, got
            release()

    return docs.mapInArrow(run, schema)
