"""Line dedup by a deletion-neighbourhood join.

Two lines are similar where few enough words are inserted, deleted or replaced: one for each five words of the shorter line,
three at most (lines of fewer than five words must be equal). Every line emits the variants that the deletion of one word leaves,
as hashed keys: lines of up to ten words those of the whole line, longer ones those of their first five and of their last five
words. With three edits allowed, one of these two ends holds at most one, so that similar lines share a variant (a word pushed
over the border of an end counts as the deleted one). A line costs ten keys, however long it is. Lines that share a key are
met, their edit distance is verified, and the earliest stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Words of a line for each word that may differ, and most words that may: with more, both ends may hold two edits.
WORDS_AN_EDIT, MOST_EDITS = 5, 3
#: What is cut off the ends of lines.
BLANKS = " \t\r"
#: Words of an end, and of the longest line whose variants are those of the whole line.
END, WHOLE = 5, 10
#: A key of more lines than this is crowded; a key or line of more than this share of all rows is handled without a shuffle of it.
CROWDED, HOT = 16, 1 / 1_000
#: Letters that stand for words.
LETTERS = 20_480
#: One document in so many is looked at for hot keys, and buckets that word pairs of crowded lines are counted in. Both affect speed only.
LOOKED, BUCKETS = 64, 1 << 17


def _at(prefix: str = "") -> Column:
    """Where a line stands, in the order that decides which is the earliest: null ids last."""
    return F.struct(F.col(f"{prefix}d").isNull().alias("no_id"), F.col(f"{prefix}d").alias("d"), F.col(f"{prefix}t").alias("t"), F.col(f"{prefix}pos").alias("pos"))


def _edits(n: Column, most: int) -> Column:
    """How many words of a line of n words may differ."""
    return F.least(F.floor(n / WORDS_AN_EDIT).cast("int"), F.lit(most))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _end_variants(end: Column, kind: int) -> list[Column]:
    """Hashed keys of an end of a line, of END words, without one of them, for each of them."""
    before = [F.substring_index(end, " ", i) for i in range(END)]
    after = [F.substring_index(end, " ", i + 1 - END) for i in range(END)]
    texts = [after[0], *[F.concat(before[i], F.lit(" "), after[i]) for i in range(1, END - 1)], before[-1]]
    return [F.xxhash64(F.lit(kind), t) for t in texts]


def _whole_variants(line: Column) -> Column:
    """Hashed keys of a line, and of the line without one of its words, for each of them."""
    words = F.split(line, " ")
    without = F.transform(words, lambda _, i: F.array_join(F.filter(words, lambda _, j: j != i), " "))
    return F.array_distinct(F.transform(F.concat(F.array(line), without), lambda t: F.xxhash64(F.lit(0), t)))


def _pieces(text: Column, by: str) -> Column:
    """The number of pieces that a character cuts a text into, without making them."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(by), F.lit(""))) + 1


def _trimmed(line: Column) -> Column:
    """A line without spaces, tabs and carriage returns at its ends; btrim, which goes through all of a line, sees only lines that have some."""
    some = [end for c in BLANKS for end in (line.startswith(c), line.endswith(c))]
    return F.when(reduce(Column.__or__, some), F.btrim(line, F.lit(BLANKS))).otherwise(line)


def lines_of(documents: DataFrame, counted: int | None = None) -> DataFrame:
    """d (doc_id), t (hash of the text), pos, line (without white space at its ends) and size (words) of every line but blank ones.

    Words are counted no further than counted, if given.
    """
    # the hash of the text comes first, so that no line carries the whole text along
    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    parts = docs.select("d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = parts.withColumn("line", _trimmed(F.col("line"))).where("line != ''")
    return lines.withColumn("size", _pieces(F.col("line") if counted is None else F.substring_index("line", " ", counted), " "))


def _hashed() -> list[Column]:
    """The 128-bit hash by which lines are told apart."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]


def line_keys(documents: DataFrame) -> DataFrame:
    """h1 and key of every deletion variant of every line that need not be equal to be similar."""
    lines = lines_of(documents, WHOLE + 1).where(F.col("size") >= WORDS_AN_EDIT).select(
        F.xxhash64("line").alias("h1"),
        F.substring_index("line", " ", END).alias("first"),
        F.substring_index("line", " ", -END).alias("last"),
        (F.col("size") >= WHOLE).alias("ends"),
        F.when(F.col("size") <= WHOLE, F.col("line")).alias("whole"),
    )
    none = F.array().cast("array<long>")
    of_ends = F.when(F.col("ends"), F.array(*_end_variants(F.col("first"), 1), *_end_variants(F.col("last"), 2))).otherwise(none)
    keys = F.when(F.col("whole").isNull(), of_ends).otherwise(F.concat(of_ends, F.coalesce(_whole_variants(F.col("whole")), none)))
    return lines.select("h1", F.explode(keys).alias("key"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, at (earliest place), n (occurrences) and size of every distinct line."""
    return lines.groupBy("h1", "h2").agg(F.min(_at()).alias("at"), F.count("*").alias("n"), F.first("size").alias("size"))


def shared_keys(documents: DataFrame) -> DataFrame:
    """key, h1 and crowded of the keys that more than one distinct line has.

    Keys are dealt by their value and counted there. Those that a sample shows to be hot (at most 2 / HOT by the share they need,
    so that they are broadcast) are dealt by their lines as well, uncounted, and are crowded.
    """
    some = line_keys(documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(LOOKED)) == 0))
    counted = materialize(some.groupBy("key").agg(F.count("*").alias("n")), "line-keys-looked-at")
    least = max(32, (counted.agg(F.sum("n")).first()[0] or 0) * HOT / 2)
    hot = counted.where(F.col("n") >= least).select("key", F.lit(True).alias("hot"))
    # of a hot key, whose lines are dealt by a number of their own, the key is kept as well
    salted = F.xxhash64("key", F.pmod("h1", F.lit(1_024)))
    dealt = line_keys(documents).join(F.broadcast(hot), "key", "left").select(
        F.when(F.col("hot"), salted).otherwise(F.col("key")).alias("deal"), "h1", F.when(F.col("hot"), F.col("key")).alias("hot_key")
    )
    of_deal = Window.partitionBy("deal")
    several = dealt.withColumns({"least": F.min("h1").over(of_deal), "most": F.max("h1").over(of_deal)}).where("least < most OR hot_key IS NOT NULL")
    # what is left is little: a line that brings a key more than once is counted once
    found = several.select("deal", "h1", "hot_key").distinct().withColumn("lines", F.count("*").over(of_deal))
    return found.select(F.coalesce("hot_key", "deal").alias("key"), "h1", ((F.col("lines") > CROWDED) | F.col("hot_key").isNotNull()).alias("crowded"))


def _of_texts(documents: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """documents with what a table says of their texts (d, t)."""
    per_text = per_text.withColumnsRenamed({"d": "line_dedup_d", "t": "line_dedup_t"})
    found = documents.join(per_text, F.col("doc_id").eqNullSafe(F.col("line_dedup_d")) & (F.xxhash64("text") == F.col("line_dedup_t")), how)
    return found.drop("line_dedup_d", "line_dedup_t")


def _letters(documents: DataFrame, places: DataFrame) -> DataFrame:
    """h1, h2 and the words of lines (h1, h2, at) as one letter each, in two alphabets by a word's hash."""
    per_text = places.groupBy("at.d", "at.t").agg(F.collect_list(F.struct("h1", "h2", "at.pos")).alias("wanted"))
    texts = _of_texts(documents.select("doc_id", "text"), per_text, "inner").select(F.split("text", "\n").alias("parts"), "wanted")
    # lines are picked before they become rows, so that no row carries the whole text along
    each = texts.select(F.inline(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), F.element_at("parts", w["pos"] + 1).alias("line")))))
    hashes = each.select("h1", "h2", F.transform(F.split(_trimmed(F.col("line")), " "), lambda w: F.xxhash64(w)).alias("words"))
    alphabet = F.split(F.lit("".join(map(chr, range(0x4E00, 0x4E00 + LETTERS)))), "")

    def letters(shift: int) -> Column:
        return F.array_join(F.transform("words", lambda h: F.element_at(alphabet, F.pmod(F.shiftright(h, shift), F.lit(LETTERS)).cast("int") + 1)), "")

    # rows equal in doc_id and text bring the same line more than once
    return hashes.select("h1", "h2", letters(0).alias("a"), letters(32).alias("b")).dropDuplicates(["h1", "h2"])


def _verified(pairs: DataFrame, letters: DataFrame, most: int) -> DataFrame:
    """h1, h2 of the pairs (h1, h2, e1, e2) within the bound.

    The distance of two lines is that of their letters, in both alphabets: of the words that share a letter of one alphabet
    hardly any share that of the other.
    """
    both = pairs.join(letters, ["h1", "h2"]).join(letters.toDF("e1", "e2", "e_a", "e_b"), ["e1", "e2"])
    both = both.withColumn("k", _edits(F.least(F.length("a"), F.length("e_a")), most))
    return both.where("levenshtein(a, e_a, k) >= 0 AND levenshtein(b, e_b, k) >= 0").select("h1", "h2").distinct()


def _pairs(later: DataFrame, earlier: DataFrame, most: int) -> DataFrame:
    """h1, h2, e1, e2 of the lines of two tables (key, h1, h2, at, size) that share a key, as far as order and sizes allow."""
    earlier = earlier.select("key", *[F.col(c).alias(f"e_{c}") for c in ("h1", "h2", "at", "size")])
    met = later.join(earlier, "key").where((F.col("at") > F.col("e_at")) & (F.abs(F.col("size") - F.col("e_size")) <= _edits(F.least("size", "e_size"), most)))
    return met.select("h1", "h2", F.col("e_h1").alias("e1"), F.col("e_h2").alias("e2")).distinct()


def _rare_pairs(members: DataFrame, letters: DataFrame, most: int) -> DataFrame:
    """members (h1, h2, at, size) with key: the rarest pairs of neighbouring words of each line.

    k edits take away at most 2k of a line's distinct pairs, so that of 2k + 1 of them, in an order common to all lines, similar
    lines share one; lines of no more than 4k distinct pairs, all of which may go, have one more key in common.
    """
    low = F.lit((1 << 56) - 1)

    def pairs(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.xxhash64(x, y)))

    words = F.filter(F.split("a", ""), lambda x: x != "")
    paired = materialize(members.join(letters, ["h1", "h2"]).select("h1", "h2", "at", "size", _let(words, pairs).alias("pairs")), "line-word-pairs")
    weights = bytearray(BUCKETS)
    for r in paired.select(F.explode("pairs").alias("p")).groupBy(F.pmod("p", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).collect():
        weights[r["bucket"]] = min(r["n"].bit_length(), 63)
    weight = lambda h: F.ascii(F.substring(F.lit(bytes(weights)), F.pmod(h, F.lit(BUCKETS)).cast("int") + 1, F.lit(1)).cast("string"))
    order = F.sort_array(F.transform("pairs", lambda h: F.shiftleft(weight(h).cast("long"), 56).bitwiseOR(h.bitwiseAND(low))))
    k = _edits(F.col("size"), most)
    keys = F.concat(F.slice(order, F.lit(1), 2 * k + 1), F.when(F.size("pairs") <= 4 * k, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")))
    return paired.select("h1", "h2", "at", "size", F.explode(keys).alias("key"))


def near_duplicates(documents: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """h1, h2 of every line within the bound of an earlier line, whether or not that one is itself such a line.

    Lines of a key that is not crowded are compared pair by pair. Lines of crowded keys are first compared with the earliest line
    of each and with the one that occurs most often, which settles most lines of large groups. Those that it doesn't settle are
    compared with the earlier lines of the same keys that share one of their rarest word pairs as well.
    """
    keyed = materialize(shared_keys(documents), "line-keys", True)
    keyed = materialize(keyed.join(lines, "h1"), "keyed-lines", True)
    letters = materialize(_letters(documents, keyed.select("h1", "h2", "at").distinct()), "line-letters", True)
    crowded, few = keyed.where("crowded"), keyed.where("NOT crowded")
    line = F.struct("h1", "h2", "at", "size")
    heads = materialize(crowded.groupBy("key").agg(F.min(F.struct("at", line.alias("line"))).alias("first"), F.max(F.struct("n", line.alias("line"))).alias("most")), "line-heads", True)
    heads = heads.select("key", F.col("first.line").alias("line")).unionByName(heads.select("key", F.col("most.line").alias("line"))).select("key", "line.*")
    pairs = materialize(_pairs(few, few, most).unionByName(_pairs(crowded, heads, most)), "line-pairs")
    settled = materialize(_verified(pairs, letters, most), "lines-settled")
    unsettled = crowded.join(settled, ["h1", "h2"], "left_anti")
    members = crowded.join(unsettled.select("key").distinct(), "key", "left_semi").select("h1", "h2", "at", "size").distinct()
    rare = materialize(_rare_pairs(members, letters, most), "line-rare-pairs")
    late = rare.join(unsettled.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    rest = materialize(_pairs(late, rare, most), "line-pairs")
    return settled.unionByName(_verified(rest, letters, most)).distinct()


def removed_lines(documents: DataFrame, most: int) -> DataFrame:
    """d, t and line_dedup_gone (positions of the lines that go, ascending) of every document that loses a line."""
    occurrences = materialize(lines_of(documents).select("d", "t", "pos", *_hashed(), "size"), "lines")
    lines = materialize(distinct_lines(occurrences), "distinct-lines", True)
    near = near_duplicates(documents, lines, most).withColumn("near", F.lit(True))
    repeated = materialize(lines.select("h1", "h2", "at", "n").join(near, ["h1", "h2"], "left").where("n > 1 OR near"), "lines-repeated", True)
    # lines of more than HOT of all occurrences, of which there are fewer than 1 / HOT, are broadcast, so that no task gets such a line whole
    hot = F.col("n") > max(1, occurrences.count() * HOT)
    places = occurrences.select("d", "t", "pos", "h1", "h2")
    often = F.broadcast(repeated.where(hot))
    found = places.join(often, ["h1", "h2"]).unionByName(places.join(often, ["h1", "h2"], "left_anti").join(repeated.where(~hot), ["h1", "h2"]))
    gone = found.where(F.col("near") | (F.col("at") != _at())).select("d", "t", "pos")
    return gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("pos")).alias("line_dedup_gone"))


def dedup_lines(documents: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """documents with n_lines, n_removed and a text without its duplicate lines.

    Lines are compared without spaces, tabs and carriage returns at their ends; their words are separated by single spaces. Blank
    lines stay. A line goes where an equal line, or one within the edit bound, stands earlier: in a document of smaller doc_id
    (null last), or above in the same. The bound is a word for each five words of the shorter line, and no more than edits (0 to
    MOST_EDITS) words.
    Rows equal in doc_id and text count as one document and get the same text. A null text stays null, with no lines. An empty
    table gives an empty result. Other columns are kept, those named n_lines or n_removed replaced.
    """
    if not 0 <= edits <= MOST_EDITS:
        raise ValueError(f"edits must be from 0 to {MOST_EDITS}")
    gone = materialize(removed_lines(documents, edits), "lines-gone", True)
    # other columns ride along as one struct, so that their names can't clash
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    packed = documents.select("doc_id", "text", *([F.struct(*[documents[c] for c in others]).alias("line_dedup_others")] if others else []))
    joined = _of_texts(packed, gone, "left")
    parts = F.split("text", "\n")
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("line_dedup_gone", i)), "\n")
    deduped = joined.withColumns(
        {
            "n_lines": F.coalesce(_pieces(F.col("text"), "\n"), F.lit(0)),
            "n_removed": F.coalesce(F.array_size("line_dedup_gone"), F.lit(0)),
            "text": F.when(F.col("line_dedup_gone").isNull(), F.col("text")).otherwise(left),
        }
    )
    own = [F.col("line_dedup_others")[c].alias(c) if c in others else F.col(c) for c in documents.columns if c not in ("n_lines", "n_removed")]
    return deduped.select(*own, "n_lines", "n_removed")


def keep_deduped(documents: DataFrame) -> DataFrame:
    """The pipeline's stage: the columns of documents, with texts deduped and n_chars renewed, others as they were; documents left blank go.

    Null texts and blank ones stay as they are, repeated rows stay repeated, and an empty table gives an empty result.
    """
    rows = documents.select("doc_id", "text", F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    out = dedup_lines(rows).where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(BLANKS + "\n")) != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")["n_chars"]) if "n_chars" in documents.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in documents.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and text of every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES: dict[str, str] = {}
