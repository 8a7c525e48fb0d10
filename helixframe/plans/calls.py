"""Queries on back-splice calls, call sets and evaluation counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, report
from ..sources import tool_calls
from .registry import query

TOOLS = ["click", "error", "purchase", "signup", "view"]

CONSENSUS = """
letters AS (SELECT chr, spos, epos, i, substr(upper({s}), i, 1) AS b, count(*) AS n FROM v_bsj, range(1, 3) t(i) GROUP BY ALL),
votes AS (SELECT chr, spos, epos, i, sum(n) AS n, sum(CASE WHEN b='A' THEN n ELSE 0 END) AS a, sum(CASE WHEN b='C' THEN n ELSE 0 END) AS c, sum(CASE WHEN b='G' THEN n ELSE 0 END) AS g, sum(CASE WHEN b='T' THEN n ELSE 0 END) AS t FROM letters GROUP BY chr, spos, epos, i),
{out} AS (SELECT chr, spos, epos, string_agg(CASE WHEN greatest(a,c,g,t) < n // 2 THEN 'N' WHEN a = greatest(a,c,g,t) THEN 'A' WHEN c = greatest(a,c,g,t) THEN 'C' WHEN g = greatest(a,c,g,t) THEN 'G' ELSE 'T' END, '' ORDER BY i) AS s FROM votes GROUP BY chr, spos, epos)
"""


def _consensus(signal: str, out: str) -> str:
    return CONSENSUS.replace("{s}", signal).replace("{out}", out).replace("letters", f"letters_{out}").replace("votes", f"votes_{out}")


REPORT_SQL = f"""
WITH {_consensus('start_signal', 'cs')}, {_consensus('end_signal', 'ce')},
g AS (SELECT chr, spos, epos, count(*) AS support, min(type) AS best, arg_min(start_bp_ref, CAST(type AS BIGINT) * 1000000000 + rname) AS rs, arg_min(end_bp_ref, CAST(type AS BIGINT) * 1000000000 + rname) AS re,
      string_agg(CAST(rname AS VARCHAR), ',' ORDER BY rname) AS reads FROM v_bsj GROUP BY chr, spos, epos),
rp AS (SELECT g.chr, g.spos AS start_pos, g.epos AS end_pos, support, 'STC' AS type, cs.s || '-' || ce.s AS consensus_signal, rs || '-' || re AS ref_signal,
       CASE WHEN cs.s = rs AND ce.s = re THEN 'Pass' ELSE 'Fail' END AS pass, reads
FROM g JOIN cs USING (chr, spos, epos) JOIN ce USING (chr, spos, epos) WHERE best = 20)"""


@query("bsj_report", f"{REPORT_SQL} SELECT * FROM rp")
def _(v):
    return report.bsj_report(v("v_bsj"))


@query("signal_consensus", f"WITH {_consensus('end_signal', 'ce')} SELECT chr, spos, epos, s AS consensus FROM ce")
def _(v):
    return report.signal_consensus(v("v_bsj"), ["chr", "spos", "epos"], "end_signal")


@query("pair_consensus", """
SELECT pair_id, CASE WHEN length(q) = length(r) THEN list_aggregate(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(q, i, 1) = substr(r, i, 1) THEN substr(q, i, 1) ELSE 'N' END), 'string_agg', '') ELSE '' END AS consensus
FROM v_pairs""")
def _(v):
    return v("v_pairs").select("pair_id", report.pair_consensus(F.col("q"), F.col("r")).alias("consensus"))


@query("pass_fail", "SELECT rname, CASE WHEN start_signal = start_bp_ref AND end_signal = end_bp_ref THEN 'Pass' ELSE 'Fail' END AS pass FROM v_bsj")
def _(v):
    return v("v_bsj").select("rname", report.pass_fail(*map(F.col, ("start_signal", "end_signal", "start_bp_ref", "end_bp_ref"))).alias("pass"))


@query("sort_report", "SELECT chr, spos, epos, type, rname FROM v_bsj")
def _(v):
    return report.sort_report(v("v_bsj").select("chr", "spos", "epos", "type", "rname"))


@query("best_circ_type", """
WITH c AS (SELECT rname % 1000 AS rname, rname AS ord, CASE WHEN spos % 7 = 0 THEN 1 ELSE type END AS type FROM v_bsj),
s AS (SELECT rname, min(CASE WHEN type = 20 THEN ord END) AS stop, min(CASE WHEN type < 20 THEN ord END) AS linear FROM c GROUP BY rname)
SELECT c.rname, min(type) AS type FROM c JOIN s ON c.rname = s.rname
WHERE (stop IS NULL OR ord <= stop) AND (linear IS NULL OR linear > coalesce(stop, 4611686018427387904)) AND type BETWEEN 20 AND 22 GROUP BY c.rname""")
def _(v):
    calls = v("v_bsj").select((F.col("rname") % 1000).alias("rname"), F.col("rname").alias("ord"), F.when(F.col("spos") % 7 == 0, 1).otherwise(F.col("type")).alias("type"))
    return report.best_circ_type(calls, "ord")


@query("best_mapping", """
SELECT rname, ord, type, gm, ed, tlen, mlen FROM (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY type, gm DESC, CASE WHEN type < 3 THEN ed END NULLS FIRST, CASE WHEN type < 3 THEN tlen END NULLS FIRST, mlen DESC, ed, ord, tlen) AS k FROM v_map_cand) WHERE k = 1""")
def _(v):
    return report.best_mapping(v("v_map_cand"))


@query("sample_matrix", "SELECT chr, start_pos, end_pos, " + ", ".join(f"coalesce(max(CASE WHEN tool = '{t}' THEN support END), 0) AS {t}" for t in TOOLS) + " FROM v_calls GROUP BY chr, start_pos, end_pos")
def _(v):
    return compare.sample_matrix(v("v_calls"), "tool", TOOLS)


@query("cpm_normalise", """
SELECT tool, cond, concat(chr, '_', start_pos, '_', end_pos) AS event, round(least(support * 1e6 / reads, 0.5), 6) AS cpm FROM v_calls JOIN v_sizes USING (tool, cond)""")
def _(v):
    return compare.cpm_normalise(v("v_calls"), v("v_sizes"), ["tool", "cond"])


PRE_POST = """
pre AS (SELECT tool, chr, start_pos, end_pos, support AS pre FROM v_calls WHERE cond = 'pre'),
post AS (SELECT tool, chr, start_pos, end_pos, support AS post FROM v_calls WHERE cond = 'post'),
pp AS (SELECT tool, chr, start_pos, end_pos, coalesce(pre, 0) AS pre, coalesce(post, 0) AS post FROM pre {how} JOIN post USING (tool, chr, start_pos, end_pos)),
rc AS (SELECT tool, max(CASE WHEN cond = 'pre' THEN reads END) AS pre_rc, max(CASE WHEN cond = 'post' THEN reads END) AS post_rc FROM v_sizes GROUP BY tool),
er AS (SELECT pp.*, CASE WHEN pre = 0 THEN -1.0 ELSE round(CAST(post * pre_rc AS DOUBLE) / (pre * post_rc), 6) END AS ratio FROM pp JOIN rc USING (tool)),
rk AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY pre DESC, post, chr, start_pos, end_pos) AS rank FROM er)
"""
LEFT, FULL = PRE_POST.replace("{how}", "LEFT"), PRE_POST.replace("{how}", "FULL")


def _ratios(v, how="left"):
    return compare.enrichment_ratio(compare.pre_post_join(v("v_calls"), how), v("v_sizes"))


@query("pre_post_join", f"WITH {LEFT} SELECT * FROM pp")
def _(v):
    return compare.pre_post_join(v("v_calls"))


@query("enrichment_ratio", f"WITH {FULL} SELECT *, CASE WHEN ratio >= 5 THEN 'Y' WHEN ratio >= 1 THEN 'X' ELSE '-' END AS label FROM er")
def _(v):
    return _ratios(v, "full_outer")


@query("top_x_events", f"WITH {LEFT} SELECT tool, chr, start_pos, end_pos, pre, post, CAST(rank AS INTEGER) AS rank, ratio >= 1 AS not_depleted, ratio >= 5 AS enriched FROM rk WHERE rank <= 100")
def _(v):
    return compare.top_x_events(_ratios(v))


@query("top10_of_top100", f"WITH {LEFT} SELECT tool, chr, start_pos, end_pos, pre, post, CAST(rank AS INTEGER) AS rank, ratio >= 1 AS not_depleted, ratio >= 5 AS enriched FROM rk WHERE rank <= 10")
def _(v):
    return compare.top_x_events(_ratios(v), 100).where("rank <= 10")


@query("event_table", f"WITH {LEFT} SELECT chr, start_pos, end_pos, " + ", ".join(f"max(CASE WHEN tool = '{t}' THEN ratio END) AS {t}" for t in TOOLS) + " FROM rk WHERE rank <= 100 GROUP BY chr, start_pos, end_pos")
def _(v):
    return compare.event_table(_ratios(v), TOOLS, 100)


@query("tool_overlap_matrix", f"WITH {LEFT} SELECT a.tool, b.tool AS other, count(*) AS shared FROM rk a JOIN rk b ON a.chr = b.chr AND a.start_pos = b.start_pos AND a.end_pos = b.end_pos AND a.rank <= 100 AND b.rank <= 100 GROUP BY ALL")
def _(v):
    return compare.tool_overlap_matrix(_ratios(v))


SUMMARY = f"""{LEFT},
ds AS (SELECT tool, count(*) AS n_pre, CAST(sum(CASE WHEN ratio >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS not_depleted,
  {', '.join(f"CAST(sum(CASE WHEN rank <= {k} AND pre >= 2 AND ratio >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS top{k}_{n}" for k in (10, 100) for n, t in (('not_depleted', 1), ('enriched', 5)))} FROM rk GROUP BY tool),
dp AS (SELECT tool, count(*) AS n_post FROM post GROUP BY tool),
dd AS (SELECT *, round(100.0 * not_depleted / n_pre, 6) AS percent FROM ds JOIN dp USING (tool))"""


def _summary(v):
    return compare.depletion_summary(_ratios(v), v("v_calls").where("cond = 'post'"))


@query("depletion_summary", f"WITH {SUMMARY} SELECT * FROM dd")
def _(v):
    return _summary(v)


@query("confidence_score", f"WITH {SUMMARY} SELECT tool, round(pow(1.3, top100_not_depleted * top100_enriched / 100.0), 6) AS size, round(log2(n_pre), 6) AS log_events FROM dd")
def _(v):
    return compare.confidence_score(_summary(v))


@query("top_call_split", f"WITH {SUMMARY} SELECT tool, top100_enriched AS enriched, top100_not_depleted - top100_enriched AS neither FROM dd")
def _(v):
    return _summary(v).select("tool", F.col("top100_enriched").alias("enriched"), (F.col("top100_not_depleted") - F.col("top100_enriched")).alias("neither"))


@query("event_union", "SELECT DISTINCT chr, start_pos, end_pos FROM v_calls")
def _(v):
    return compare.event_union(v("v_calls"))


@query("event_intersection", "SELECT chr, start_pos, end_pos FROM v_calls WHERE tool = 'click' INTERSECT SELECT chr, start_pos, end_pos FROM v_calls WHERE tool = 'view'")
def _(v):
    calls = v("v_calls")
    return compare.event_intersection(calls.where("tool = 'click'"), calls.where("tool = 'view'"))


@query("run_diff", """
WITH a AS (SELECT chr, start_pos, end_pos, sum(support) AS before FROM v_calls WHERE cond = 'pre' GROUP BY ALL), b AS (SELECT chr, start_pos, end_pos, sum(support) AS after FROM v_calls WHERE cond = 'post' GROUP BY ALL)
SELECT chr, start_pos, end_pos, CAST(coalesce(before, 0) AS BIGINT) AS before, CAST(coalesce(after, 0) AS BIGINT) AS after,
       CASE WHEN before IS NULL THEN 'NA' WHEN after IS NULL THEN 'DI' WHEN after > before THEN '++' WHEN after < before THEN '--' ELSE 'NC' END AS tag
FROM a FULL JOIN b USING (chr, start_pos, end_pos)""")
def _(v):
    total = v("v_calls").groupBy("cond", *compare.KEY).agg(F.sum("support").alias("support"))
    return compare.run_diff(total.where("cond = 'pre'"), total.where("cond = 'post'"))


@query("read_set_diff", """
WITH a AS (SELECT chr, spos, epos, list(rname) AS r FROM v_bsj WHERE rname % 3 <> 0 GROUP BY ALL), b AS (SELECT chr, spos, epos, list(rname) AS r FROM v_bsj WHERE rname % 3 <> 1 GROUP BY ALL)
SELECT chr, spos AS start_pos, epos AS end_pos,
  coalesce(nullif(array_to_string(list_sort(list_filter(a.r, lambda x: NOT list_contains(b.r, x))), ','), ''), '-') AS lost,
  coalesce(nullif(array_to_string(list_sort(list_filter(b.r, lambda x: NOT list_contains(a.r, x))), ','), ''), '-') AS gained
FROM a JOIN b USING (chr, spos, epos)""")
def _(v):
    def run(cond):
        return v("v_bsj").where(cond).groupBy("chr", F.col("spos").alias("start_pos"), F.col("epos").alias("end_pos")).agg(F.collect_list("rname").alias("reads"))

    return compare.read_set_diff(run("rname % 3 <> 0"), run("rname % 3 <> 1"))


COUNTS = """SELECT tool, cond, sum(CASE WHEN support >= 3 THEN 1 ELSE 0 END) AS tp, count(*) AS detected, count(*) + 50 AS total FROM v_calls GROUP BY tool, cond"""


def _counts(v):
    return v("v_calls").groupBy("tool", "cond").agg(F.sum((F.col("support") >= 3).cast("long")).alias("tp"), F.count("*").alias("detected"), (F.count("*") + 50).alias("total"))


@query("precision_recall", f"WITH k AS ({COUNTS}) SELECT tool, cond, CAST(tp AS BIGINT) AS tp, detected, total, CAST(detected - tp AS BIGINT) AS fp, round(tp / total, 6) AS recall, round(tp / detected, 6) AS precision FROM k")
def _(v):
    return compare.precision_recall(_counts(v))


@query("pr_shift", f"""WITH k AS ({COUNTS}), p AS (SELECT tool, cond, round(tp / total, 6) AS r, round(tp / detected, 6) AS p FROM k)
SELECT a.tool, round(sqrt(pow(a.r - b.r, 2) + pow(a.p - b.p, 2)), 6) AS shift FROM p a JOIN p b ON a.tool = b.tool AND a.cond = 'pre' AND b.cond = 'post'""")
def _(v):
    pr = compare.precision_recall(_counts(v))
    return compare.pr_shift(pr.where("cond = 'pre'"), pr.where("cond = 'post'"))


RUNS = "SELECT l_suppkey % 5 AS run, l_linenumber AS seed_limit, count(*) AS total, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS concordant, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS discordant, sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS correct FROM lineitem GROUP BY ALL"


@query("mapping_accuracy", f"""WITH r AS ({RUNS}), s AS (SELECT seed_limit, 100.0 * correct / total AS c, 100.0 * (concordant + discordant - correct) / total AS i, 100.0 * (total - concordant - discordant) / total AS u FROM r)
SELECT seed_limit, round(avg(c), 6) AS correct_mean, round(stddev_samp(c), 6) AS correct_std, round(avg(i), 6) AS incorrect_mean, round(stddev_samp(i), 6) AS incorrect_std, round(avg(u), 6) AS unmapped_mean, round(stddev_samp(u), 6) AS unmapped_std FROM s GROUP BY seed_limit""")
def _(v):
    n = lambda c: F.sum(F.expr(c).cast("long"))
    runs = v("lineitem").groupBy((F.col("l_suppkey") % 5).alias("run"), F.col("l_linenumber").alias("seed_limit")).agg(
        F.count("*").alias("total"), n("l_returnflag = 'N'").alias("concordant"), n("l_returnflag = 'R'").alias("discordant"), n("l_returnflag = 'N' AND l_linestatus = 'O'").alias("correct")
    )
    return compare.mapping_accuracy(runs, "seed_limit")


@query("resource_summary", """
WITH w AS (SELECT event_type AS tool, sum(user_id) AS s, max(event_id) AS k FROM events GROUP BY event_type)
SELECT tool, 'minutes' AS metric, round(s / 60.0, 6) AS value FROM w UNION ALL SELECT tool, 'hours', round(s / 3600.0, 6) FROM w UNION ALL SELECT tool, 'gb', round(k / 1048576.0, 6) FROM w""")
def _(v):
    return compare.resource_summary(v("events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("seconds"), F.col("event_id").alias("kb")))


@query("calls_high_conf", "SELECT rname, chr, spos, epos FROM v_bsj WHERE type = 20 AND start_signal = start_bp_ref AND end_signal = end_bp_ref")
def _(v):
    verdict = report.pass_fail(*map(F.col, ("start_signal", "end_signal", "start_bp_ref", "end_bp_ref")))
    return v("v_bsj").where((F.col("type") == 20) & (verdict == "Pass")).select("rname", "chr", "spos", "epos")


@query("min_support", "SELECT * FROM v_calls WHERE support >= 3")
def _(v):
    return v("v_calls").where("support >= 3")


LINES = {
    "own": "concat_ws(chr(9), chr, start_pos, end_pos, support, CASE WHEN support % 2 = 0 THEN 'STC' ELSE 'MTC' END, 'GT', 'AG', CASE WHEN support % 3 = 0 THEN 'Fail' ELSE 'Pass' END)",
    "find_circ": "concat_ws(chr(9), chr, start_pos - 1, end_pos, 'x', support)",
    "CIRI": "concat_ws(chr(9), 'id', chr, start_pos, end_pos, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, support)",
    "NCLscan": "concat_ws(chr(9), chr, end_pos, CASE WHEN support % 2 = 0 THEN '+' ELSE '-' END, 'x', start_pos, 6, 7, 8, 9, 10, support)",
}


@query("src_tool_calls", """
SELECT 'own' AS tool, chr, start_pos, end_pos, support FROM v_calls WHERE support % 2 = 0 AND support % 3 <> 0
UNION ALL SELECT 'find_circ', chr, start_pos, end_pos, support FROM v_calls UNION ALL SELECT 'CIRI', chr, start_pos, end_pos, support FROM v_calls
UNION ALL SELECT 'NCLscan', chr, CASE WHEN support % 2 = 0 THEN start_pos ELSE end_pos END, CASE WHEN support % 2 = 0 THEN end_pos ELSE start_pos END, support FROM v_calls""")
def _(v):
    calls = v("v_calls")
    out = None
    for tool, line in LINES.items():
        rows = tool_calls.tool_calls(calls.select(F.expr(line.replace("chr(9)", "char(9)")).alias("value")), tool)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("knife_filter", """
SELECT 'KNIFE' AS tool, chr, start_pos, end_pos, support FROM v_calls WHERE NOT (support % 3 = 0 AND support % 2 = 0)""")
def _(v):
    line = "concat_ws(char(9), concat_ws('|', chr, concat('g:', CASE WHEN support % 2 = 0 THEN end_pos ELSE start_pos END), concat('h:', CASE WHEN support % 2 = 0 THEN start_pos ELSE end_pos END), 'reg', CASE WHEN support % 2 = 0 THEN '+' ELSE '-' END), 'x', CASE WHEN support % 3 = 0 THEN '-1.5' ELSE '0.9' END, 'x', CASE WHEN support % 2 = 0 THEN '-1' ELSE '0.5' END, support)"
    return tool_calls.knife_calls(v("v_calls").select(F.expr(line).alias("value")))


@query("event_key", "SELECT chr, start_pos, end_pos, concat(chr, ':', start_pos, '-', end_pos) AS region, concat(chr, '_', start_pos, '_', end_pos) AS key FROM v_calls")
def _(v):
    cols = [F.regexp_replace("chr", "^chr", ""), F.col("start_pos"), F.col("end_pos")]
    return v("v_calls").select(*compare.KEY, compare.event_key(*cols, sep=":").alias("region"), compare.event_key(*cols).alias("key"))
