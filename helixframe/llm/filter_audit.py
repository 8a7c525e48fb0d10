"""Filter interaction audit: what every order of the filters removes, and each filter's Shapley value, by the potential.

A document is the set of filters that it fails. Documents are counted by that set, so that the removal game of a part (how many
documents a coalition of filters removes) and two further games (of the good and of the toxic ones) are sums over a table of
32 rows a part. The potential of the game follows from those of the smaller coalitions; a filter's Shapley value is the
potential of all filters less the potential without it. The steps of an order are differences of coalitions.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: The filters in the order of their bits: A short, B repetitive, C shouting, D symbols, E copy of an earlier document.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The games: columns of the counted table that are summed over the documents that a coalition removes.
GAMES = ("n", "good", "toxic")


def content_failures(text: Column) -> dict[str, Column]:
    """Failure of A to D, which need the text alone; word_list and text must be columns of the frame (see failing_sets)."""
    n, distinct = F.size("word_list"), F.size(F.array_distinct("word_list"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def failing_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of the filters that fail) and n, good, toxic: documents with that part and that set.

    A null text counts as empty, a null source as the part ``''``. A document fails E if any row with a smaller doc_id has the same
    text; rows of one doc_id don't remove each other, and a row without doc_id neither fails E nor makes another fail it. A
    document is good (toxic) if any row of labels with its doc_id says so. Copies are counted by digest, part and labels before they meet.
    """
    flagged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    texts = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.withColumn("word_list", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(content_failures(F.col("text")).values())]
    rows = words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("failed"))
    judged = rows.join(flagged, "doc_id", "left").select("doc_id", "part", "digest", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    # the join has dealt the rows by doc_id, so that the first count moves nothing; the second leaves a row for each text, part and labels
    kinds = ["digest", "part", "failed", "good", "bad"]
    per_id = judged.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    firsts = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = per_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), firsts.alias("first"))
    met = copies.withColumn("earliest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    stays = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("earliest"), F.col("first.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    each = met.select("part", "good", "bad", F.explode(F.array(F.struct(F.col("failed").alias("failed"), stays.alias("n")), F.struct((F.col("failed") + e).alias("failed"), (F.col("n") - stays).alias("n")))).alias("x"))
    summed = {"n": F.sum("x.n"), "good": F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)), "toxic": F.sum(F.when(F.col("bad"), F.col("x.n")).otherwise(0))}
    return each.groupBy("part", F.col("x.failed").alias("failed")).agg(*[s.cast("long").alias(k) for k, s in summed.items()])


def coalition_games(counted: DataFrame) -> DataFrame:
    """part, total and the arrays n, good, toxic: for every coalition (as bits) what its filters remove together."""
    every = range(1 << len(FILTERS))
    games = [F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(s) != 0, F.col(g)).otherwise(0)).cast("long") for s in every]).alias(g) for g in GAMES]
    return counted.groupBy("part").agg(F.sum("n").alias("total"), *games)


def with_shapley(games: DataFrame) -> DataFrame:
    """games with shapley, an array: each filter's removals summed over all orders, that is its Shapley value times their number.

    The potential P of a coalition S of s filters is (v(S) + the sum of P over S less one filter) / s. len(ORDERS) * P is an
    integer for every coalition, as s! divides len(ORDERS), so that long division is exact.
    """
    k = len(FILTERS)
    frame = games.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, k + 1):
        layer = {}
        for members in combinations(range(k), size):
            s = sum(1 << i for i in members)
            parts = [F.col(f"p{s - (1 << i)}") for i in members]
            layer[f"p{s}"] = F.expr(f"n[{s}] * {len(ORDERS)}L")
            for p in parts:
                layer[f"p{s}"] = layer[f"p{s}"] + p
            layer[f"p{s}"] = F.call_function("div", layer[f"p{s}"], F.lit(size).cast("long"))
        frame = frame.withColumns(layer)
    whole = (1 << k) - 1
    shapley = F.array(*[F.col(f"p{whole}") - F.col(f"p{whole - (1 << i)}") for i in range(k)])
    return frame.select(*games.columns, shapley.alias("shapley"))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Documents, ties and nulls are counted as in failing_sets; every order and step is there, with zeros. An empty table
    gives an empty result. Other columns of either table are ignored.
    """
    games = with_shapley(coalition_games(failing_sets(documents, labels)))
    orders = games.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0])
    so_far = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, i: s + F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", i, F.lit(1))) - ord(FILTERS[0])))
    at = steps.withColumns({"i": place, "after": so_far}).withColumn("own", F.expr("shiftleft(1, i)")).withColumn("before", F.expr("after - own"))
    whole = (1 << len(FILTERS)) - 1
    removed = F.expr("n[after] - n[before]")
    return at.select(
        "part",
        "filter_order",
        "step",
        F.expr("total - n[after]").alias("kept"),
        removed.alias("removed"),
        (F.expr("n[own]") - removed).alias("redundant"),
        F.expr(f"n[{whole}] - n[{whole} - own]").alias("unique_fails"),
        F.expr("good[after] - good[before]").alias("good_lost"),
        F.expr("toxic[after] - toxic[before]").alias("toxic_lost"),
        F.expr("shapley[i]").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN d.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN m USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, CAST(i AS INTEGER), 1) AS own, substr(filter_order, 1, CAST(i AS INTEGER) - 1) AS before FROM o, range(1, 6) r(i)),
j AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN translate(fails, concat(before, own), '') = fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM j
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": ORACLE}
