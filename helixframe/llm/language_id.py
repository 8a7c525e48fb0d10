"""Language identification by compression: the language whose dictionary shortens a text most is its language.

Each language gets a zstandard raw-content dictionary of labelled text. A text is compressed once with each dictionary; the
smallest result names the language (long texts in pieces, whose sizes are added up), and a narrow margin to the next one means that the answer is not trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Bounds of the labelled sample: documents for each language and characters of each (also the bound of a dictionary).
SAMPLE_DOCS, SAMPLE_CHARS = 64, 1_500
#: Compression level, and the margin (share of the second smallest size) under which an answer is rejected.
LEVEL, MIN_MARGIN = 6, 0.005
#: Bytes of a text compressed at once: a dictionary saves a bounded number of bytes, which in longer ones counts for less and less.
PIECE = 4_000
#: The answer for a text without a letter.
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _clean(text: str) -> bytes:
    """Lower case, ASCII other than letters as single spaces."""
    return b" ".join([b"", *text.lower().encode().translate(_LETTERS).split(), b""])


def held_out() -> Column:
    """True for the quarter of documents that nothing is learnt from; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn_dictionaries(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary text of each language of a table (text, lang), most frequent language first.

    A bounded sample: of each language the docs texts smallest by hash, chars characters of each. The counts of languages are
    those of all rows. Rows with a null text or lang teach nothing.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    w = Window.partitionBy("lang").orderBy("h", "piece")
    sample = rows.select("lang", "h", F.substring("text", 1, chars).alias("piece")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= docs)
    texts: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "place").collect():
        texts.setdefault(r["lang"], []).append(r["piece"])
    return {lang: _clean("\n".join(texts[lang])) for lang in sorted(texts, key=lambda x: (-counts[x], x))}


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, text in dictionaries.items():
        content = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def predict(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """The language and the margin, 1 - smallest / second smallest; ties go to the more frequent language."""
    if text is None or not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    data = _clean(text)
    pieces = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
    sizes = [sum(len(c.compress(x)) for x in pieces) for _, c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for i, s in enumerate(sizes) if i != best]
    return compressors[best][0], 1.0 - sizes[best] / min(rest) if rest else 1.0


def identify_languages(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """documents with lang_pred, score (0 to 1) and rejected in place of any columns of these names.

    Only text is read for a prediction. A null text, or one without a letter, is ``und`` with score 0 and rejected, as is
    every text where no dictionary exists. Rows that repeat, and null doc_ids, are predicted like any other. An empty table gives
    an empty result.
    """
    frame = documents.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*frame.schema, *(T.StructField(n, k) for n, k in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())))])
    text_at = frame.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries)
        for batch in batches:
            found = [predict(x.as_py(), compressors) for x in batch.column(text_at)]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            gone = [f[0] == UNKNOWN or f[1] < MIN_MARGIN for f in found]
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def keep_identified(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of documents whose language is identified with a sufficient margin, with all their columns as they were.

    The columns ride along as one struct, so that their names can't clash with those of the prediction. Null texts and texts without a
    letter go; repeated rows stay repeated; an empty table gives an empty result.
    """
    rows = documents.select("text", F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    return identify_languages(rows, dictionaries).where(~F.col("rejected")).select("row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = learn_dictionaries(documents.where(~held_out()))
    return identify_languages(documents.select("doc_id", "text", held_out().alias("held_out")), dictionaries).drop("text")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
