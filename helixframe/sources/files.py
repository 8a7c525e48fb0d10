"""Sequence, alignment and report files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P

PAM = "rname string, " + ", ".join(f"chr{m} string, spos{m} long, epos{m} long, mlen{m} int, qspos{m} int, qepos{m} int, dir{m} string, ed{m} int" for m in (1, 2)) + ", tlen int, junc_num int, gm_compatible int, type int"
#: Categories that carry coordinates in a PAM file.
PLACED = (0, 1, 2, 3, 4, 5, 7)
REPORT = "chr string, start_pos long, end_pos long, support long, type string, consensus_signal string, ref_signal string, pass string, reads string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chr, seq, len of FASTA files: a record is the text between two '>' at line starts; of each line the first token counts."""
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", ""))
    lines = F.split("value", "\r?\n")
    seq = F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.regexp_extract(x, r"^\s*(\S*)", 1)), "")
    return records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chr"), seq.alias("seq")).where("chr <> ''").withColumn("len", F.length("seq").cast("long"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, i (from 0) and line of text files, however they are split.

    Lines are counted for each split first; the few counts, summed over the splits of a file before it, tell where its lines begin.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("file", "split", (before - F.col("least")).alias("shift")), ["file", "split"]).select("file", (F.col("id") + F.col("shift")).alias("i"), "line")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, rec (from 0), rname, seq, qual, ok of FASTQ files, which may be split: the lines of a file are taken by fours.

    ok says that sequence and quality have one length. /1 and /2 at the end of names go. Records without a name are left out.
    """
    part = lambda k: F.max(F.when(F.col("i") % 4 == k, F.regexp_replace("line", r"\s+$", "")))
    rows = numbered_lines(spark, path).groupBy("file", F.floor(F.col("i") / 4).alias("rec")).agg(part(0).alias("name"), part(1).alias("seq"), part(3).alias("qual")).where("name <> ''")
    name = F.regexp_replace(F.regexp_extract("name", r"^@(\S+)", 1), "/[12]$", "")
    return rows.select("file", "rec", name.alias("rname"), "seq", "qual", (F.length("seq") == F.length("qual")).alias("ok"))


def pair_fastq(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by position in their files: pair (of files, from 1), rec, rname, seq1, seq2, same_name.

    The files of either side, in the order of their names, are the pairs.
    """

    def in_pairs(side: DataFrame) -> DataFrame:
        names = side.select(F.col("file").alias("name")).distinct()
        return side.join(names.withColumn("pair", F.row_number().over(Window.orderBy("name"))), F.col("file") == F.col("name"))

    a = in_pairs(first).select("pair", "rec", "rname", F.col("seq").alias("seq1"))
    b = in_pairs(second).select("pair", "rec", F.col("rname").alias("rname2"), F.col("seq").alias("seq2"))
    return a.join(b, ["pair", "rec"]).select("pair", "rec", "rname", "seq1", "seq2", (F.col("rname") == F.col("rname2")).alias("same_name"))


def read_pam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", nullValue="*", schema=PAM)


def write_pam(mapped: DataFrame, path: str) -> None:
    """Rows in the 21 columns; only categories in PLACED carry coordinates, the others '*'."""
    names = [c.split()[0] for c in PAM.split(", ")]
    mapped.select(*[F.col(c) if c in ("rname", "type") else F.when(F.col("type").isin(*PLACED), F.col(c)).alias(c) for c in names]).write.csv(path, sep="\t", nullValue="*", mode="overwrite")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Primary alignments with their tags as a map; header lines and flags of 256 or more are left out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    tags = F.map_from_entries(F.transform(F.slice(c, 12, F.size(c)), lambda t: F.struct(F.split(t, ":")[0], F.regexp_extract(t, "^[^:]*:[^:]*:(.*)$", 1))))
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    return rows.select(*[F.get(c, i).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)], tags.alias("tags")).where("flag < 256")


def write_sam(sam: DataFrame, header: DataFrame, path: str) -> None:
    """Header lines and rows as one text dataset, the header in files of its own that sort first, in the order of header's tasks.

    What the header is made from may be large (sequences whose length it lists), so its tasks are not brought into one.
    """
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    tags = F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat(k, F.lit(":i:"), F.element_at("tags", k)))
    header.select("line").write.mode("overwrite").text(f"{path}/part=0")
    sam.select(F.array_join(F.concat(F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("*")) for n in names]), tags), "\t").alias("line")).write.mode("overwrite").text(f"{path}/part=1")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report rows; of the older layout, without signals and verdict, the reads stand in the sixth column."""
    rows = spark.read.csv(path, sep="\t", schema=REPORT)
    old = F.col("reads").isNull()
    listed = F.split(F.when(old, F.col("consensus_signal")).otherwise(F.col("reads")), ",")
    return rows.withColumns({"reads": listed, "consensus_signal": F.when(~old, F.col("consensus_signal"))})


def write_report(report: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in REPORT.split(", ")]
    report.select(*names).orderBy("chr", "start_pos", "end_pos").write.csv(path, sep="\t", mode="overwrite")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Split mappings with their call type; a missing second partial mate is written as '*'."""
    candidates.orderBy("rname", "type").write.csv(path, sep="\t", nullValue="*", mode="overwrite")
