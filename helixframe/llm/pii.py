"""Personal data: seed patterns, and bootstrapped contexts that find what the seed patterns miss.

Seeds are e-mail addresses, IP addresses, card numbers and phone numbers. The one or two words on either side of a seed, by
themselves, together, or with the shape of the seed, become lexical patterns; patterns and the identifier-like tokens in them
(numbers, also with spaces inside, and addresses, also with "[at]" and "(dot)") form a graph on which scores are passed to and
fro: a pattern is as good as its tokens, a token as its patterns. Tokens that good patterns agree on are reported with the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Characters of context looked at on either side, rounds of scoring, distinct seeds that a pattern needs, least score.
CONTEXT, ROUNDS, SUPPORT, LEAST_SCORE = 48, 3, 3, 0.9
#: What a pattern's confidence is shrunk by: s of n tokens count as s / (n + DOUBT).
DOUBT = 1.0

# The seed patterns with single characters in place of groups that repeat: a mark stands for a dot between label characters,
# or for a separator between digits, so that no match needs the stack however long it is.
_MARK, _OTHER = "\u0001", "\u0002"
_EMAIL = f"(?:(?<![A-Za-z0-9._%+{_MARK}-])|\\G)[A-Za-z0-9._%+{_MARK}-]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_MARK}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT, _DOT = r"[\[({](?:at|AT)[\])}]", r"[\[({](?:dot|DOT)[\])}]"
_TOKEN = rf"(?<!\S)\S*(?:[0-9@]|{_AT})\S*"
_EDGES = "\"'.,;:!?<>"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once: lambdas would work out an outer expression again for each element."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str) -> Column:
    """start, end (code points), value, left and right (what is around) of the leftmost non-overlapping matches."""
    around = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern).alias("between"))

    def placed(s: Column) -> Column:
        found, between = s["found"], s["between"]
        lengths = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, b: F.length(v) + F.length(b))
        contexts = F.zip_with(F.slice(between, 1, F.size(found)), F.slice(between, 2, F.size(found)), lambda x, y: F.struct(F.right(x, F.lit(CONTEXT)).alias("left"), F.left(y, F.lit(CONTEXT)).alias("right")))
        ended = F.zip_with(found, _running(lengths), lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.zip_with(ended, contexts, lambda e, c: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value"), c["left"].alias("left"), c["right"].alias("right")))

    return _let(around, placed)


def _running(lengths: Column) -> Column:
    """Running sums, in blocks of 64, so that long arrays don't take quadratic time."""
    zero = F.array().cast("array<int>")
    add = lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x))

    def blocks(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(each) - 1) / 64), F.lit(0)).cast("int")), lambda k: F.slice(each, k * 64 + 1, F.lit(64)))

    def summed(parts: Column) -> Column:
        totals = F.aggregate(F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), F.array(F.lit(0)), add)
        return F.flatten(F.zip_with(parts, F.slice(totals, F.lit(1), F.size(parts)), lambda b, t: F.transform(F.aggregate(b, zero, add), lambda x: x + t)))

    return _let(_let(lengths, blocks), summed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0


def _is_ip(value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.rlike(value, F.lit(f"^{part}\\.{part}\\.{part}\\.{part}$"))


def seed_spans(text: Column) -> dict[str, Column]:
    """Of each kind, the valid matches of its seed pattern: arrays as from _spans. Failing matches are dropped, without retries."""
    plain = F.translate(text, _MARK, _OTHER)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
    none = F.filter(_spans(F.lit(""), _PHONE), lambda x: F.lit(False))
    card_ok = lambda x: _let(_digits(x["value"]), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    return {
        "email": F.when(F.contains(text, F.lit("@")), _spans(dotted, _EMAIL)).otherwise(none),
        "ip": F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(_spans(text, _IP), lambda x: _is_ip(x["value"]))).otherwise(none),
        "card": F.when(F.rlike(text, F.lit("[0-9][ -]?[0-9]")), F.filter(_spans(joined, _CARD), card_ok)).otherwise(none),
        "phone": F.when(F.rlike(text, F.lit(r"\+[0-9]")), F.filter(_spans(text, _PHONE), lambda x: F.length(_digits(x["value"])).between(8, 15))).otherwise(none),
    }


def _labelled(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: s.withField("kind", F.lit(kind)))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _tokens(text: Column) -> Column:
    """Spans of identifier-like tokens: words with an at sign or four digits or more, without punctuation at their ends.

    Spaces between the groups of a number, and around "[at]" and "[dot]", count as part of the token.
    """
    joined = F.regexp_replace(text, rf"(?<=[0-9)]) (?=[(0-9])| (?={_AT}|{_DOT})|(?<={_AT}|{_DOT}) ", _MARK)

    def core(s: Column) -> Column:
        value = F.btrim(s["value"], F.lit(_EDGES))
        start = s["start"] + F.length(s["value"]) - F.length(F.ltrim(s["value"], F.lit(_EDGES)))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    likely = lambda s: F.rlike(s["value"], F.lit(f"@|{_AT}")) | (F.length(_digits(s["value"])) >= 4)
    return F.when(F.rlike(text, F.lit(f"[0-9@]|{_AT}")), F.filter(F.transform(_spans(joined, _TOKEN), core), likely))


def scanned(documents: DataFrame) -> DataFrame:
    """d (doc_id), t (hash of the text), seeds and tokens (identifier-like, other than by chance also seeds) of every row."""
    docs = documents.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("x"))
    x = F.col("x")
    arrays = [_labelled(a, k) for k, a in enumerate(seed_spans(x).values())]
    return docs.select("d", F.xxhash64("x").alias("t"), F.concat(*arrays).alias("seeds"), _tokens(x).alias("tokens"))


def _words(context: Column, last: bool) -> Column:
    """The two words next to a token, nearest first, lower-cased, without punctuation; null where there is none."""
    each = F.split(F.trim(F.regexp_replace(F.lower(context), r"[^\p{L}=:#]+", " ")), " ")
    near = F.reverse(each) if last else each
    return F.transform(F.array(F.get(near, F.lit(0)), F.get(near, F.lit(1))), lambda w: F.nullif(w, F.lit("")))


def _shape(value: Column) -> Column:
    """Digits as 9 and runs of letters as a, with "[at]" and "[dot]" written out and without spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT, "."), f"[ {_MARK}]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\p{L}+", "a"), "[0-9]", "9")


def _patterns(left: Column, right: Column, value: Column) -> Column:
    """The patterns an occurrence is in: each tells which of its parts it is made of."""
    parts = F.struct(_words(left, True).alias("l"), _words(right, False).alias("r"), F.left(_shape(value), F.lit(CONTEXT)).alias("s"))

    def named(p: Column) -> Column:
        l1, l2, r1, r2 = p["l"][0], p["l"][1], p["r"][0], p["r"][1]
        made = [("L", l1), ("LL", l2, l1), ("R", r1), ("RR", r1, r2), ("LR", l1, r1), ("LS", l1, p["s"]), ("SR", p["s"], r1)]
        # concat is null where a part is
        return F.array_compact(F.array(*[F.concat(F.lit(name), *[x for part in rest for x in (F.lit("\t"), part)]) for name, *rest in made]))

    return _let(parts, named)


def occurrences(found: DataFrame) -> DataFrame:
    """d, t, kind (null for a token that is no seed), start, end, node (hash of the value) and patterns."""
    seeds = found.select("d", "t", F.explode("seeds").alias("s")).select("d", "t", "s.*")
    tokens = found.where(F.size("tokens") > 0).select("d", "t", F.explode("tokens").alias("s")).select("d", "t", "s.*", F.lit(None).cast("int").alias("kind"))
    spans = seeds.select("d", "t", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    over = tokens.alias("k").join(spans.alias("s"), F.col("k.d").eqNullSafe(F.col("s.d")) & (F.col("k.t") == F.col("s.t")) & (F.col("s_start") < F.col("k.end")) & (F.col("s_end") > F.col("k.start")), "left_anti")
    rows = seeds.unionByName(over)
    # a node stands for a value wherever it occurs
    return rows.select("d", "t", "kind", "start", "end", F.xxhash64("value").alias("node"), _patterns(F.col("left"), F.col("right"), F.col("value")).alias("patterns"))


def bootstrap(rows: DataFrame) -> DataFrame:
    """node and kind of the tokens that the contexts of seeds give a score of LEAST_SCORE or more.

    rows: as from occurrences. In each round a pattern's confidence in a kind is the mean score of its distinct nodes (seeds
    count 1 for their own kind, 0 for another; a pattern needs SUPPORT distinct seeds of a kind) over one DOUBT more than
    they are, and a token's score is 1 - product(1 - confidence) over its patterns. Edges are distinct pairs, aggregated before
    every join; that of a word before a third of all tokens is one key of the joins, whose large side the adaptive plan splits.
    """
    edges = rows.select("node", "kind", F.explode("patterns").alias("p")).groupBy("p", "node").agg(F.min("kind").alias("kind"))
    seeds = edges.where("kind IS NOT NULL").groupBy("p", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    nodes = edges.groupBy("p").agg(F.count("*").alias("nodes"))
    base = materialize(seeds.join(nodes, "p"), "pii-patterns")
    open_edges = materialize(edges.where("kind IS NULL").select("p", "node").join(base.select("p").distinct(), "p", "left_semi"), "pii-edges")
    confidence = base.withColumn("confidence", F.col("seeds") / (F.col("nodes") + DOUBT))
    scores = None
    for _ in range(ROUNDS):
        met = open_edges.join(confidence.select("p", "kind", "confidence"), "p")
        doubt = F.least(F.col("confidence"), F.lit(0.999999))
        scores = materialize(met.groupBy("node", "kind").agg((1 - F.exp(F.sum(F.log(1 - doubt)))).alias("score")), "pii-scores")
        gained = open_edges.join(scores, "node").groupBy("p", "kind").agg(F.sum("score").alias("gained"))
        confidence = base.join(gained, ["p", "kind"], "left").withColumn("confidence", (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("nodes") + DOUBT))
    best = scores.groupBy("node").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    return best.where(F.col("b.score") >= LEAST_SCORE).select("node", (-F.col("b.k")).alias("kind"))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, seeds and found of every row: arrays of struct(kind, start, end), kind being an index into KINDS.

    start and end are code points, end exclusive; both arrays are ordered by kind and start. A null text counts as empty. Rows
    equal in doc_id and text have equal results. An empty table gives an empty result. Other columns are ignored.
    """
    seen = materialize(scanned(documents), "pii-scanned")
    rows = materialize(occurrences(seen), "pii-occurrences")
    found = rows.where("kind IS NULL").drop("kind").join(bootstrap(rows), "node")
    per_text = found.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    seeds = F.array_sort(F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    joined = seen.alias("a").join(per_text.alias("b"), F.col("a.d").eqNullSafe(F.col("b.d")) & (F.col("a.t") == F.col("b.t")), "left")
    return joined.select(F.col("a.d").alias("doc_id"), seeds.alias("seeds"), F.coalesce("found", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("found"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [_count("seeds", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    everything = F.array_sort(F.concat("seeds", "found"))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("seeds")).cast("binary"), 256).alias("base_sha256"), _listed(everything).alias("spans"), F.size("found").alias("n_found"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
