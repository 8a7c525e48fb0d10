r"""Fill-in-the-middle examples, cut through a piecewise-linear learned index of token boundaries.

The tokens of a text (a word with the white space before it; white space at the end) end at ascending offsets. An index keeps
lines that are at most ERROR off over a segment of ranks, and for each boundary the residual, a signed byte. A cut after the
k-th token is predicted by the line of its segment, and the residual makes it exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .word_arrays import slabs

#: The most that a line may be off, in code points; residuals fit a signed byte.
ERROR = 127
#: Percent of texts transformed, and of these percent written suffix first.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in code points (from the start of its text) of the boundaries of all tokens of a slab, and where each text's begin.

    A text of n tokens has n + 1 boundaries, 0 the first.
    """
    texts = len(offsets) - 1
    inside = ~_SPACE[data]
    last = np.zeros(len(data), bool)  # last bytes of words
    last[:-1] = inside[:-1] & ~inside[1:]
    full = offsets[1:][offsets[1:] > offsets[:-1]]
    last[full - 1] = True  # of a text's last token, be it a word or white space
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    ends = np.flatnonzero(last) + 1
    text = np.searchsorted(offsets[1:], ends, "left")
    count = np.bincount(text, minlength=texts)
    begin = np.zeros(texts + 1, np.int64)
    np.cumsum(count + 1, out=begin[1:])
    out = np.zeros(begin[-1], np.int64)
    out[np.arange(len(ends)) + text + 1] = points[ends] - points[offsets[text]]
    return out, begin


class RankIndex:
    """Error-bounded segments over the boundary offsets of many texts, with their residuals.

    A segment is halved while its chord is more than error off somewhere; a segment of two boundaries has none.
    """

    def __init__(self, offsets: np.ndarray, begin: np.ndarray, error: int = ERROR) -> None:
        first, last = begin[:-1].astype(np.int64), begin[1:] - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        self.residuals = np.zeros(len(offsets), np.int8)
        while len(first):
            size = last - first + 1
            flat = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            seg = np.repeat(np.arange(len(first)), size)
            off = offsets[flat] - _on_line(offsets[first], offsets[last], last - first, seg, flat - first[seg])
            worst = np.maximum.reduceat(np.abs(off), np.cumsum(size) - size)
            fits = worst <= error
            kept = fits[seg]
            self.residuals[flat[kept]] = off[kept]
            done.append((first[fits], last[fits]))
            a, b = first[~fits], last[~fits]
            middle = (a + b) // 2
            first, last = np.concatenate([a, middle + 1]), np.concatenate([middle, b])
        self.first = np.concatenate([d[0] for d in done] or [np.empty(0, np.int64)])
        order = np.argsort(self.first)
        self.first = self.first[order]
        self.last = np.concatenate([d[1] for d in done] or [np.empty(0, np.int64)])[order]
        self.low, self.high = offsets[self.first], offsets[self.last]

    def predict(self, at: np.ndarray) -> np.ndarray:
        """What the lines say for boundaries, counted over all texts."""
        seg = np.searchsorted(self.first, at, "right") - 1
        return _on_line(self.low, self.high, self.last - self.first, seg, at - self.first[seg])

    def exact(self, at: np.ndarray) -> np.ndarray:
        return self.predict(at) + self.residuals[at]


def _on_line(low: np.ndarray, high: np.ndarray, steps: np.ndarray, seg: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer points of the chords of segments seg at x steps from their begin."""
    return low[seg] + (high - low)[seg] * x // np.maximum(steps, 1)[seg]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, seed: int = 42, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (code points, null if plain) and output of every row of documents.

    The draws of a row depend on its doc_id alone (a null one counts as the empty string), so that rows that repeat come out alike.
    A null text counts as empty. Empty texts and those that hold a marker stay plain. An empty table gives an empty result; columns
    other than doc_id and text are ignored. A text is held by one task at a time, its index beside it.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    drawn = documents.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slabs(batch.column(1)):
                part = batch.slice(a, b - a)
                ends, begin = boundaries(data, offsets)
                index = RankIndex(ends, begin)
                n = np.diff(begin) - 1
                draws = [part.column(c).to_numpy() % (n + 1) for c in (3, 4)]
                cut1, cut2 = (index.exact(begin[:-1] + f(*draws)) for f in (np.minimum, np.maximum))
                forms = part.column(2).to_pylist()
                made = [_rendered(t, f, i, j) for t, f, i, j in zip(part.column(1).to_pylist(), forms, cut1.tolist(), cut2.tolist())]
                is_plain = np.array([f == "plain" for f in forms])
                columns = [part.column(0), pa.array(n), part.column(2), pa.array(cut1, mask=is_plain), pa.array(cut2 - cut1, mask=is_plain), pa.array(made, batch.schema.field(1).type)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return drawn.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _rendered(text: str, form: str, i: int, j: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text from which output was made. No marker but those put in can occur in an output that is not plain."""
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    k = len(PREFIX)
    middle = F.substring(output, m + k, F.length(output))
    psm = F.concat(F.substring(output, F.lit(k + 1), s - k - 1), middle, F.substring(output, s + k, m - s - k))
    spm = F.concat(F.substring(output, p + k, m - p - k), middle, F.substring(output, F.lit(k + 1), p - k - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
g AS (SELECT *, len(w) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
             CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": ORACLE}
