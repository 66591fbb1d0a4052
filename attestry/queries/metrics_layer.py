"""Queries over quality metrics, the ledger, generated prose and whole plans."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from attestry.conf import DEFAULT
from attestry.functions.text import clean_lines
from attestry.operators import ledger, store
from attestry.operators import metrics as M
from attestry.operators.narrative import check_narratives
from attestry.plans import invariance
from attestry.plans.assess import Evidence
from attestry.plans.evaluate import evaluate
from attestry.plans.screen import results_rows, screen_corpus
from attestry.queries.oracle import lines
from attestry.queries.registry import query
from attestry.session import shared_dir
from attestry.sources.corpus import as_layout

CONF = replace(DEFAULT, as_of=date(2026, 7, 1))

# --- metrics ------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_name, p_type),
    t AS (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_retailprice > 950 GROUP BY p_name, p_type)
    SELECT p_name, p_type, least(coalesce(p.n, 0), coalesce(t.n, 0)) AS matched,
           coalesce(t.n, 0) - least(coalesce(p.n, 0), coalesce(t.n, 0)) AS missed, coalesce(p.n, 0) - least(coalesce(p.n, 0), coalesce(t.n, 0)) AS extra
    FROM p FULL JOIN t USING (p_name, p_type)""")
def match_claims(t):
    return M.match_counts(
        t.part.where("p_size > 10"), t.part.where("p_retailprice > 950"), ["p_name", "p_type"]
    )


@query("""
    WITH p AS (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_name, p_type),
    t AS (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_retailprice > 950 GROUP BY p_name, p_type),
    c AS (SELECT p_type, sum(least(coalesce(p.n, 0), coalesce(t.n, 0))) AS tp, sum(coalesce(p.n, 0)) AS np, sum(coalesce(t.n, 0)) AS nt
          FROM p FULL JOIN t USING (p_name, p_type) GROUP BY p_type)
    SELECT p_type, CAST(tp AS BIGINT) AS tp, round(tp / nullif(np, 0), 6) AS precision, round(tp / nullif(nt, 0), 6) AS recall, round(2 * tp / nullif(np + nt, 0), 6) AS f1 FROM c""")
def claim_prf(t):
    counts = M.match_counts(
        t.part.where("p_size > 10"), t.part.where("p_retailprice > 950"), ["p_name", "p_type"]
    )
    out = M.precision_recall(counts, ["p_type"])
    return out.select(
        "p_type", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


def _labelled(t):
    # a stand-in verdict beside each label
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id")


@query("""
    SELECT quality, count(CASE WHEN toxic = 0 THEN 1 END) AS "0", count(CASE WHEN toxic = 1 THEN 1 END) AS "1"
    FROM labels GROUP BY quality""")
def confusion_matrix(t):
    return M.confusion_matrix(t.labels, "quality", "toxic", [0, 1])


@query("""
    WITH m AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2),
    l AS (SELECT x.label, sum(CASE WHEN a = label AND b = label THEN n ELSE 0 END) AS tp,
                 sum(CASE WHEN a <> b AND (a = label OR b = label) THEN n ELSE 0 END) AS wrong
          FROM m, (SELECT unnest([0, 1]) AS label) x GROUP BY x.label)
    SELECT 'macro_f1' AS metric, round(avg(2 * tp / (2 * tp + wrong)), 6) AS value, count(*) AS n FROM l
    UNION ALL SELECT 'accuracy', round(sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM m""")
def macro_f1(t):
    matrix = M.confusion(t.labels, "quality", "toxic")
    f1 = M.macro_f1(matrix, "quality", "toxic")
    acc = M.accuracy(matrix, "quality", "toxic")
    return f1.select(
        F.lit("macro_f1").alias("metric"), F.round("macro_f1", 6).alias("value"), F.col("labels").alias("n")
    ).unionByName(
        acc.select(F.lit("accuracy").alias("metric"), F.round("accuracy", 6).alias("value"), "n")
    )


@query("""
    WITH s AS (SELECT lang, n_chars, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT lang, pos, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM s),
    g AS (SELECT lang, sum(CASE WHEN pos THEN r END) AS rp, count(CASE WHEN pos THEN 1 END) AS n_pos, count(CASE WHEN NOT pos THEN 1 END) AS n_neg FROM r GROUP BY lang)
    SELECT lang, n_pos, n_neg, CASE WHEN n_pos * n_neg > 0 THEN round((rp - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) END AS auroc FROM g""")
def auroc(t):
    out = M.auroc(_labelled(t), "n_chars", F.col("quality") == 1, ["lang"])
    return out.select("lang", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


@query("""
    WITH r AS (SELECT (n_chars % 1000) / 1000.0::DOUBLE AS c, quality AS ok FROM documents JOIN labels USING (doc_id)),
    b AS (SELECT CAST(least(9, floor(c * 10)) AS INT) AS bin, count(*) AS n, avg(c) AS mc, avg(ok) AS acc FROM r GROUP BY 1)
    SELECT bin, n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM b
    UNION ALL SELECT -1, CAST(sum(n) AS BIGINT), NULL, round(sum(n * abs(acc - mc)) / sum(n), 6) FROM b""")
def calibration(t):
    rows = _labelled(t).withColumn("c", (F.col("n_chars") % 1000) / 1000.0)
    bins = M.calibration_bins(rows, "c", F.col("quality") == 1)
    shown = bins.select(
        "bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"),
        F.round("accuracy", 6).alias("accuracy"),
    )
    # the error itself is the extra row with bin -1
    return shown.unionByName(
        M.expected_calibration_error(bins).select(
            F.lit(-1).alias("bin"), "n", F.lit(None).cast("double").alias("mean_confidence"),
            F.round("ece", 6).alias("accuracy"),
        )
    )


@query("""
    SELECT lang, round(avg(quality), 6) AS value, count(*) AS n_units, true AS inside, true AS plausible
    FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def bootstrap_ci(t):
    units = _labelled(t).select("lang", F.col("quality").alias("num"), F.lit(1).alias("den"))
    ci = M.bootstrap_ci(units, "num", "den", ["lang"])
    # the interval itself depends on the draws; it must hold the estimate and have the width
    # the normal approximation predicts
    expected = 3.92 * F.sqrt(F.col("value") * (1 - F.col("value")) / F.col("n_units"))
    width = F.try_divide(F.col("hi") - F.col("lo"), expected)
    return ci.select(
        "lang", F.round("value", 6).alias("value"), "n_units",
        F.col("value").between(F.col("lo"), F.col("hi")).alias("inside"),
        F.coalesce(width.between(0.7, 1.3), F.col("hi") == F.col("lo")).alias("plausible"),
    )


@query("""
    SELECT coalesce(event_type, 'all') AS kind, coalesce(CAST(user_id % 3 AS VARCHAR), 'all') AS subtype, count(*) AS n,
           CAST(sum((value > 50)::INT) AS BIGINT) AS hits, round(avg((value > 50)::INT), 6) AS recall
    FROM events GROUP BY ROLLUP (event_type, user_id % 3)""")
def detection_recall(t):
    cases = t.events.select(
        "event_type", (F.col("user_id") % 3).cast("string").alias("sub"), "value"
    )
    out = M.detection_recall(cases, "event_type", "sub", F.col("value") > 50)
    return out.select(
        F.coalesce("event_type", F.lit("all")).alias("kind"),
        F.coalesce("sub", F.lit("all")).alias("subtype"), "n", "hits",
        F.round("recall", 6).alias("recall"),
    )


@query("""
    SELECT CASE WHEN user_id % 2 = 0 THEN 'github' ELSE 'no-github' END || CASE WHEN user_id % 3 = 0 THEN '+linkedin' ELSE '' END AS sources,
           CAST(sum((value > 70)::INT) AS BIGINT) AS flagged, count(*) AS n, round(avg((value > 70)::INT), 6) AS rate
    FROM events GROUP BY 1""")
def false_flag_rates(t):
    combo = F.concat(
        F.when(F.col("user_id") % 2 == 0, "github").otherwise("no-github"),
        F.when(F.col("user_id") % 3 == 0, "+linkedin").otherwise(""),
    )
    out = M.false_flag_rates(t.events, F.col("value") > 70, combo)
    return out.withColumn("rate", F.round("rate", 6))


@query("""
    SELECT event_type, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS low, count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS mid,
           count(CASE WHEN user_id % 3 = 2 THEN 1 END) AS high FROM events GROUP BY event_type""")
def band_by_kind(t):
    bands = F.array(F.lit("low"), F.lit("mid"), F.lit("high"))
    rows = t.events.select(
        "event_type", F.get(bands, (F.col("user_id") % 3).cast("int")).alias("band")
    )
    return M.band_by_kind(rows, "event_type", "band", ["low", "mid", "high"])


@query("""
    WITH s AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN (length(text) > 300)::INT END) AS fa, max(CASE WHEN role = 'assistant' THEN (length(text) > 300)::INT END) AS fb,
                 max(CASE WHEN role = 'user' THEN length(text) END) AS sa, max(CASE WHEN role = 'assistant' THEN length(text) END) AS sb FROM conversations GROUP BY conv_id)
    SELECT count(*) AS n, round(avg(fa), 6) AS rate_first, round(avg(fb), 6) AS rate_second, round((avg(fb) - avg(fa)) * 100, 4) AS gap_pp,
           round(avg(sb - sa), 6) AS mean_delta, CAST(max(sa - sb) AS BIGINT) AS max_drop, round(avg((fa = fb AND sa = sb)::INT), 6) AS identical
    FROM s WHERE fa IS NOT NULL AND fb IS NOT NULL""")
def paired_gap(t):
    runs = t.conversations.select(
        "conv_id", "role", (F.length("text") > 300).alias("flag"), F.length("text").alias("score")
    )
    g = M.paired_gap(runs, "conv_id", "role", "user", "assistant", flag="flag", score="score")
    return g.select(
        "n", F.round("rate_first", 6).alias("rate_first"), F.round("rate_second", 6).alias("rate_second"),
        F.round("gap_pp", 4).alias("gap_pp"), F.round("mean_delta", 6).alias("mean_delta"),
        F.col("max_drop").cast("long").alias("max_drop"), F.round("identical", 6).alias("identical"),
    )


@query("""
    WITH b AS (SELECT event_id, CASE WHEN value > 90 THEN 'far' WHEN value > 60 AND event_type = 'error' THEN 'error' WHEN value > 60 THEN 'near' END AS bucket FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY event_id) AS rn FROM b WHERE bucket IS NOT NULL)
    SELECT bucket, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN event_id END, ',' ORDER BY event_id) AS examples FROM r GROUP BY bucket""")
def error_buckets(t):
    bucket = (
        F.when(F.col("value") > 90, "far")
        .when((F.col("value") > 60) & (F.col("event_type") == "error"), "error")
        .when(F.col("value") > 60, "near")
    )
    rows = t.events.withColumn("what", F.col("event_id").cast("string"))
    out = M.error_buckets(rows, bucket, "what", "event_id")
    return out.select("bucket", "n", F.array_join("examples", ",").alias("examples"))


@query("""
    SELECT count(*) AS citations, count(o_orderkey) AS resolved, round(count(o_orderkey) / count(*), 6) AS validity
    FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) o ON l_orderkey = o_orderkey""")
def citation_validity(t):
    artefacts = t.orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("key"))
    cites = t.lineitem.select(F.col("l_orderkey").alias("key"))
    out = M.citation_validity(cites, artefacts, ["key"])
    return out.withColumn("validity", F.round("validity", 6))


@query("""
    WITH c AS (SELECT event_type, 'p' || (user_id % 4) AS producer, value > 70 AS fell, CASE WHEN value > 60 THEN 'r' || (user_id % 3) END AS why FROM events),
    n AS (SELECT event_type, producer, count(*) AS n FROM c GROUP BY 1, 2),
    m AS (SELECT event_type, producer, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, producer) AS rn FROM n),
    f AS (SELECT event_type, why, min(producer) AS p FROM c WHERE why IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT event_type, string_agg(why, '; ' ORDER BY p, why) AS reason FROM f GROUP BY 1)
    SELECT c.event_type, any_value(m.producer) AS producer, count(*) AS calls, bool_or(fell) AS fell_back, any_value(reason) AS reason
    FROM c JOIN m ON m.event_type = c.event_type AND rn = 1 LEFT JOIN g ON g.event_type = c.event_type GROUP BY c.event_type""")
def producer_tally(t):
    calls = t.events.withColumn("producer", F.concat(F.lit("p"), F.col("user_id") % 4))
    why = F.when(F.col("value") > 60, F.concat(F.lit("r"), F.col("user_id") % 3))
    return M.producer_tally(calls, "event_type", "producer", F.col("value") > 70, why)


_SIX = ("VERIFIED", "CORROBORATED", "WEAK", "UNSUPPORTED", "CONTRADICTED", "UNVERIFIABLE")
_VALUE = "CASE {0} WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.4 WHEN 3 THEN 0.0 WHEN 4 THEN -1.0 ELSE 0.5 END::DOUBLE"


@query(f"""
    SELECT o_orderkey, round(abs({_VALUE.format("o_orderkey % 6")} - {_VALUE.format("o_custkey % 6")}), 6) AS distance
    FROM orders WHERE o_orderkey % 6 <> o_custkey % 6 ORDER BY 2 DESC, 1 LIMIT 10""")
def worst_errors(t):
    names = F.array(*map(F.lit, _SIX))
    rows = t.orders.select(
        "o_orderkey",
        F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("gt"),
        F.get(names, (F.col("o_custkey") % 6).cast("int")).alias("status"),
    )
    out = M.worst_errors(rows, "gt", "status", "o_orderkey", 10)
    return out.select("o_orderkey", F.round("distance", 6).alias("distance"))


_RUNS = {
    # wording: (flagged, reliability)
    "primary": ("c_acctbal > 5000", "0.5"),
    "nonnative": ("c_acctbal > 4500", "0.5"),
    "private": ("c_acctbal > 5300", "0.5"),
    "p3": ("c_acctbal > 5000", "0.5 + c_nationkey / 1000"),
    "nameswap": ("c_acctbal > 5000", "CASE WHEN c_acctbal > 9500 THEN 0.4 ELSE 0.5 END"),
    "repeat": ("c_acctbal > 5000", "0.5"),
}
_GAP = "SELECT '{name}', abs({what}), count(*), {target} FROM pairs WHERE variant = '{variant}'"
_GAPS = " UNION ALL ".join(
    _GAP.format(name=name, what=what, variant=variant, target=target)
    for name, what, variant, target in (
        ("fairness gap, second wording (pp)", "(avg(fb) - avg(fa)) * 100", "nonnative", "-5.0"),
        ("fairness gap, private work (pp)", "(avg(fb) - avg(fa)) * 100", "private", "-5.0"),
        ("mean reliability change after truthful rewording", "avg(sb - sa)", "p3", "-0.05"),
        ("name-swap invariance", "avg((fa = fb AND sa = sb)::INT)", "nameswap", "1.0"),
        ("determinism", "avg((fa = fb AND sa = sb)::INT)", "repeat", "1.0"),
    )
)
_RUN_ROWS = " UNION ALL ".join(
    f"SELECT c_custkey, '{v}' AS variant, ({flagged})::INT AS flagged, ({rel})::DOUBLE AS reliability FROM customer"
    for v, (flagged, rel) in _RUNS.items()
)


# a target below zero is one that the value must stay under
@query(f"""
    WITH u AS (SELECT o_orderkey, o_orderkey % 6 AS gt, o_custkey % 6 AS st, o_custkey AS who, o_totalprice > 60000 AS found,
               0.05::DOUBLE + (o_orderkey % 10) / 10.0::DOUBLE AS conf FROM orders),
    m AS (SELECT gt, st, count(*) AS n FROM u WHERE found GROUP BY 1, 2),
    f AS (SELECT l, sum(CASE WHEN gt = l AND st = l THEN n ELSE 0 END) AS tp, sum(CASE WHEN gt <> st AND (gt = l OR st = l) THEN n ELSE 0 END) AS w
          FROM m, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS l) GROUP BY l),
    bins AS (SELECT least(9, floor(conf * 10)) AS bin, count(*) AS n, avg(conf) AS c, avg((gt = st)::INT) AS a FROM u WHERE found AND st <> 5 GROUP BY 1),
    c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'genuine' WHEN 1 THEN 'P1' ELSE 'P6' END AS kind, c_acctbal FROM customer),
    r AS (SELECT kind, c_acctbal / 10000 AS s FROM c WHERE kind <> 'P6'),
    k AS (SELECT kind, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r),
    g AS (SELECT sum(CASE WHEN kind = 'genuine' THEN rk END) AS rp, count(CASE WHEN kind = 'genuine' THEN 1 END) AS np, count(CASE WHEN kind <> 'genuine' THEN 1 END) AS nn FROM k),
    runs AS ({_RUN_ROWS}),
    pairs AS (SELECT b.variant, a.flagged AS fa, b.flagged AS fb, a.reliability AS sa, b.reliability AS sb
              FROM runs a JOIN runs b ON a.c_custkey = b.c_custkey AND a.variant = 'primary' AND b.variant <> 'primary' JOIN c ON c.c_custkey = a.c_custkey AND c.kind = 'genuine'),
    rows AS (
    SELECT 'claim extraction F1' AS metric, 2 * count(CASE WHEN found THEN 1 END) / (count(*) + count(CASE WHEN found THEN 1 END)) AS value, count(DISTINCT who) AS n, 0.85 AS target FROM u
    UNION ALL SELECT 'claim status macro-F1', avg(2 * tp / (2 * tp + w)), 6, 0.75 FROM f
    UNION ALL SELECT 'claim status accuracy', sum(CASE WHEN gt = st THEN n ELSE 0 END) / sum(n), sum(n), NULL FROM m
    UNION ALL SELECT 'calibration error, judged claims', sum(n * abs(a - c)) / sum(n), sum(n), -0.10 FROM bins
    UNION ALL SELECT 'false-accusation rate', avg((c_acctbal > 5000)::INT), count(*), -0.05 FROM c WHERE kind = 'genuine'
    UNION ALL SELECT 'private work reported as insufficient evidence', avg((c_acctbal < 1000)::INT), count(*), 0.95 FROM c WHERE kind = 'P6'
    UNION ALL SELECT 'AUROC, genuine against perturbed', (rp - np * (np + 1) / 2.0) / (np * nn), np + nn, 0.85 FROM g
    UNION ALL {_GAPS})
    SELECT metric, round(value, 6) AS value, n::BIGINT AS n, CASE WHEN target < 0 THEN value <= -target ELSE value >= target END AS met FROM rows""")
def evaluate_corpus(t):
    names = F.array(*map(F.lit, _SIX))
    key = F.col("o_custkey").cast("string").alias("candidate_id")
    claim = F.concat(F.lit("claim "), "o_orderkey").alias("text")
    truth = t.orders.select(
        key, F.col("o_orderkey").alias("claim_no"), F.lit("SKILL").alias("type"), claim,
        F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("gt"),
    )
    # every claim of a cheap order is missed
    predicted = t.orders.where("o_totalprice > 60000").select(
        key, F.col("o_orderkey").alias("claim_no"), F.lit("SKILL").alias("type"), claim,
        F.get(names, (F.col("o_custkey") % 6).cast("int")).alias("status"),
        (F.lit(0.05) + F.col("o_orderkey") % 10 / 10.0).alias("confidence"),
    )
    who = F.col("c_custkey").cast("string").alias("candidate_id")
    kinds = F.array(*map(F.lit, ("genuine", "P1", "P6")))
    kind = F.get(kinds, (F.col("c_custkey") % 3).cast("int"))
    candidates = t.customer.select(who, (kind == "genuine").alias("genuine"), kind.alias("kind"))
    renderings = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), F.expr(flagged).alias("flagged"), F.expr(rel).cast("double").alias("reliability"))
            for v, (flagged, rel) in _RUNS.items()
        ]
    )
    runs = t.customer.select(who, "c_acctbal", F.explode(renderings).alias("r")).select(
        "candidate_id", "r.variant",
        F.when(F.col("r.flagged"), "NEEDS_VERIFICATION").when(F.col("c_acctbal") < 1000, "INSUFFICIENT_EVIDENCE")
        .otherwise("MODERATE").alias("band"),
        (F.col("c_acctbal") / 10000).alias("authenticity"), "r.reliability",
    )
    rows = evaluate(predicted, truth, candidates, runs, reps=200)
    return rows.select("metric", F.round("value", 6).alias("value"), "n", "met")


# --- ledger -------------------------------------------------------------------------------


@query("""
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
    FROM events GROUP BY user_id""")
def latest_per_key(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return ledger.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )


def _fresh(t, name: str) -> str:
    """A new folder in the place every executor can reach."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("""
    SELECT CAST(user_id AS VARCHAR) AS candidate_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS kind
    FROM events GROUP BY user_id""")
def write_reports(t):
    path = _fresh(t, "reports")
    rows = t.events.select(
        F.col("user_id").cast("string").alias("candidate_id"), "ts", "event_id",
        F.col("event_type").alias("kind"),
    )
    # late rows first, then early ones, then some of all: each write must leave the newest of every key
    newest = store.newest(["candidate_id"], ["ts", "event_id"])
    for part in (rows.where("ts >= '2024-01-15'"), rows.where("ts < '2024-01-15'"), rows.where("kind = 'click'")):
        ledger.write_reports(part, path)
        # the second write starts from a merged state, and a replay of the first one adds nothing
        store.compact(t.spark, path, newest)
        ledger.write_reports(rows, path, number=0)
    return store.current(t.spark, path, newest).select("candidate_id", "event_id", "kind")


@query("""
    SELECT event_type AS event, count(*) AS n, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS k FROM events GROUP BY event_type""")
def append_audit(t):
    path = _fresh(t, "audit")
    key, at = F.col("user_id"), F.col("ts")
    rows = t.events.select(*ledger.audit_row(key, F.col("event_type"), F.struct("props", "value"), at))
    # two appends: the second adds to the first
    for part in (rows.where("at < '2024-01-15'"), rows.where("at >= '2024-01-15' OR at IS NULL")):
        ledger.append_audit(part, path)
    log = t.spark.read.parquet(path)
    k = F.get_json_object(F.get_json_object("payload", "$.props"), "$.k").cast("long")
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("""
    SELECT l_orderkey, count(*) AS total, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done,
           CASE WHEN count(*) = count(CASE WHEN l_linestatus = 'F' THEN 1 END) THEN 'complete' ELSE 'interrupted' END AS status
    FROM lineitem GROUP BY l_orderkey""")
def screening_progress(t):
    return ledger.screening_progress(
        t.lineitem, "l_orderkey", F.col("l_linestatus") == "F", restarted=F.lit(True)
    )


@query(f"""
    WITH l AS (SELECT doc_id, source, n_chars, {lines("text")} AS ls FROM documents)
    SELECT doc_id AS candidate_id, n_chars::DOUBLE AS base_score, source AS recommendation, md5(array_to_string(ls[1:2], '|')) AS strengths,
           array_to_string(list_transform(ls[1:3], lambda x: CAST(length(x) AS VARCHAR)), ',') AS gaps FROM l""")
def results_row(t):
    rows = t.spread("documents").select("doc_id", "source", "n_chars", clean_lines("text").alias("ls"))
    reports = rows.select(
        F.col("doc_id").alias("candidate_id"), F.lit(0).alias("overall_match_score"),
        F.struct(F.col("n_chars").cast("double").alias("base_score"), F.lit(1.0).alias("score_confidence")).alias("score_breakdown"),
        F.col("source").alias("recommendation"), F.col("ls").alias("matched_skills"),
        F.transform("ls", lambda x: F.length(x).cast("string")).alias("missing_or_unclear"),
        F.struct(F.lit("benign").alias("intent"), F.lit("proceed").alias("action")).alias("integrity"),
        F.struct(F.lit("MODERATE").alias("band")).alias("authenticity"),
    )
    return results_rows(reports).select(
        "candidate_id", "base_score", "recommendation",
        F.md5(F.array_join("strengths", "|")).alias("strengths"), F.array_join("gaps", ",").alias("gaps"),
    )


@query("""
    SELECT o_orderkey AS audit_id, CASE WHEN o_orderstatus = 'P' THEN 'kept ' || o_custkey
           WHEN o_totalprice > 300000 THEN o_orderpriority ELSE '' END AS note FROM orders""")
def decision_history(t):
    legacy = F.col("o_orderstatus") == "P"
    decisions = t.orders.select(
        F.col("o_orderkey").alias("audit_id"),
        F.when(~legacy, F.col("o_totalprice") > 300000).alias("note_present"),
        F.when(legacy, F.concat(F.lit("kept "), "o_custkey")).alias("legacy_note"),
    )
    notes = t.orders.where("o_totalprice > 300000").select(
        F.col("o_orderkey").alias("audit_id"), F.col("o_orderpriority").alias("note")
    )
    return ledger.decision_history(decisions, notes)


@query("""
    SELECT c_custkey, c_nationkey AS owner FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def visible_to(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("owner"))
    acl = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("owner"))
    return ledger.visible_to(rows, acl)


@query("""
    WITH due AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'),
    e AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM due)
    SELECT 'erased' AS what, CAST(c_custkey AS VARCHAR) AS key, orders AS n FROM e
    UNION ALL SELECT 'kept orders', '*', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM due)
    UNION ALL SELECT 'kept customers', '*', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM due)""")
def erase(t):
    people = t.customer.select(F.col("c_custkey").alias("candidate_id"), "c_acctbal", "c_mktsegment")
    reports = t.orders.select(F.col("o_custkey").alias("candidate_id"), "o_orderkey")
    busy = people.where("c_mktsegment = 'BUILDING'").select("candidate_id")
    kept, events = ledger.erase(
        {"customers": people, "orders": reports}, people.where("c_acctbal < 0").select("candidate_id"),
        F.lit("2026-01-01").cast("timestamp"), processing=busy,
    )
    total = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(what).alias("what"), F.lit("*").alias("key"), "n"
    )
    log = events.select(
        F.lit("erased").alias("what"), F.col("candidate_id").alias("key"),
        F.get_json_object("payload", "$.orders").cast("long").alias("n"),
    )
    return log.unionByName(total(kept["orders"], "kept orders")).unionByName(
        total(kept["customers"], "kept customers")
    )


@query("""
    SELECT 'kept candidates' AS what, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'kept authenticity_reports', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'purged candidates', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'purged authenticity_reports', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'retain_days', 20""")
def retention(t):
    tables = {
        "candidates": t.events.select("event_id", F.col("ts").alias("created_at")),
        "authenticity_reports": t.orders.select("o_orderkey", F.col("o_orderdate").alias("created_at")),
    }
    kept, event = ledger.retention(tables, 20, F.lit("2024-01-30").cast("timestamp"))
    said = lambda name: F.get_json_object("payload", f"$.{name}").cast("long")
    out = event.select(F.lit("retain_days").alias("what"), said("retain_days").alias("n"))
    for name in tables:
        out = out.unionByName(event.select(F.lit(f"purged {name}").alias("what"), said(name).alias("n")))
        count = kept[name].agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(count.select(F.lit(f"kept {name}").alias("what"), "n"))
    return out


# --- generated prose ----------------------------------------------------------------------

_LIST = ("Python", "Kafka", "Django", "React", "Docker", "MongoDB", "Java")


@query("""
    WITH n AS (SELECT l_orderkey AS k, CAST(count(*) % 8 AS INT) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT k AS doc_id, 'count_mismatch' AS type FROM n WHERE k % 5 = 0 AND n + 1 NOT IN (7, 7 - n)
    UNION ALL SELECT k, 'score_mismatch' FROM n WHERE k % 3 = 0
    UNION ALL SELECT k, 'risk_contradicts_facts' FROM n WHERE k % 4 = 0 AND n >= 2
    UNION ALL SELECT k, 'strength_contradicts_facts' FROM n WHERE k % 7 = 0 AND n < 5
    UNION ALL SELECT k, 'unknown_skill' FROM n WHERE k % 6 = 0
    UNION ALL SELECT k, 'hiring_decision' FROM n WHERE k % 11 = 0
    UNION ALL SELECT k, 'accusatory_language' FROM n WHERE k % 13 = 0""", name="check_narratives")  # fmt: skip
def check_narratives_query(t):
    n, k = F.col("n"), F.col("doc_id")
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        # how many of the seven requirements an order stands for
        (F.count(F.lit(1)) % 8).cast("int").alias("n")
    )
    names = F.array(*map(F.lit, _LIST))
    facts = base.select(
        "doc_id", F.slice(names, F.lit(1), n).alias("matched"), F.slice(names, n + 1, 7 - n).alias("missing"),
        F.array().cast("array<string>").alias("partial"), (n * 10.0).alias("base_score"),
        F.lit(7).alias("total_requirements"),
    )
    said = n + F.when(k % 5 == 0, 1).otherwise(0)
    score = n * 10 + F.when(k % 3 == 0, 3).otherwise(0)
    none = F.array().cast("array<string>")
    prose = base.select(
        "doc_id",
        F.concat(F.lit("The file meets "), said, F.lit(" of 7 requirements; the score is "), score, F.lit(".")).alias("summary"),
        F.concat(
            F.lit("See the list."), F.when(k % 11 == 0, " We should hire soon.").otherwise(""),
            F.when(k % 13 == 0, " The dates look fake.").otherwise(""),
        ).alias("rationale"),
        F.concat(
            F.when(k % 7 == 0, F.array(F.lit("Solid Docker work"))).otherwise(none),
            F.when(k % 6 == 0, F.array(F.lit("Uses Azure daily"))).otherwise(none),
        ).alias("strengths"),
        F.when(k % 4 == 0, F.array(F.lit("Lacks Apache Kafka practice, but is keen"))).otherwise(none).alias("risks"),
    )
    return check_narratives(prose, facts).select("doc_id", "type")


# --- edits and whole screenings -----------------------------------------------------------


@query("""
    WITH b AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderkey % 60 + 1 AS p, o_orderkey % 9 + 1 AS q FROM orders)
    SELECT k AS doc_id, 'primary' AS variant, md5('Skills' || chr(10) || 'Python, SQL' || chr(10) || 'Built a tool. Cut cost by ' || q || ' percent, then ' || (p + 9) || ' percent' || chr(10) || y || ' - ' || (y + 1) || chr(10) || (y + 2) || ' - Present') AS text FROM b
    UNION ALL SELECT k, 'p1', md5('Skills' || chr(10) || 'Python, SQL, Kubernetes, GraphQL, Terraform, RabbitMQ' || chr(10) || 'Built a tool. Cut cost by ' || q || ' percent, then ' || (p + 9) || ' percent' || chr(10) || y || ' - ' || (y + 1) || chr(10) || (y + 2) || ' - Present') FROM b
    UNION ALL SELECT k, 'p2', md5('Skills' || chr(10) || 'Python, SQL' || chr(10) || 'Built a tool. Cut cost by ' || q || ' percent, then ' || least(99, (p + 9) * 3) || ' percent' || chr(10) || y || ' - ' || (y + 1) || chr(10) || (y + 2) || ' - Present') FROM b
    UNION ALL SELECT k, 'p3', md5('Skills' || chr(10) || 'Python, SQL' || chr(10) || 'Engineered a tool, which delivered measurable impact. Cut cost by ' || q || ' percent, then ' || (p + 9) || ' percent' || chr(10) || y || ' - ' || (y + 1) || chr(10) || (y + 2) || ' - Present') FROM b
    UNION ALL SELECT k, 'p4', md5('Skills' || chr(10) || 'Python, SQL' || chr(10) || 'Built a tool. Cut cost by ' || q || ' percent, then ' || (p + 9) || ' percent' || chr(10) || y || ' - ' || (y + 6) || chr(10) || (y + 2) || ' - Present') FROM b""")
def text_edits(t):
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    text = F.concat(
        F.lit("Skills\nPython, SQL\nBuilt a tool. Cut cost by "), k % 9 + 1, F.lit(" percent, then "),
        k % 60 + 10, F.lit(" percent\n"), y, F.lit(" - "), y + 1, F.lit("\n"), y + 2, F.lit(" - Present"),
    )
    docs = t.spread("orders").select(k.alias("doc_id"), text.alias("text"))
    return invariance.variants(docs).select("doc_id", "variant", F.md5("text").alias("text"))


_PLAIN = ("Kafka", "Java", "MongoDB", "Azure")


def _screening_inputs(t, done=None):
    """One resume per customer, one job description per nation; `done` is what was done at work."""
    done = F.lit("\n- kept things running") if done is None else done
    names = F.array(*map(F.lit, _PLAIN))
    n = F.col("n_nationkey")
    jds = t.nation.select(
        n.alias("jd_id"),
        F.concat(
            F.lit("Must have\n- Strong practical "), F.get(names, n % 4),
            F.lit(" knowledge in daily work\n- "), n % 7,
            F.lit("+ years of professional work in a team\nPreferred\n- "), F.get(names, (n + 1) % 4),
            F.lit(" would be used at times too\n"),
        ).alias("text"),
    )
    c = F.col("c_custkey")
    have = F.filter(
        F.transform(names, lambda s, i: F.when(F.floor(c / F.pow(F.lit(2.0), i)) % 2 == 1, s)),
        lambda s: s.isNotNull(),
    )
    text = F.concat(
        F.lit("Experience\nEngineer at Org "), c, F.lit(", 2015 - "), F.lit(2015) + c % 6, done, F.lit("\nSkills\n"),
        F.array_join(F.concat(F.array(F.lit("Go"), F.lit("Vue"), F.lit("SQLite")), have), ", "),
    )
    docs = t.spread("customer").select(c.cast("string").alias("doc_id"), text.alias("text"))
    apps = t.customer.select(
        c.cast("string").alias("candidate_id"), c.cast("string").alias("doc_id"), F.col("c_nationkey").alias("jd_id")
    )
    return apps, docs, jds


_SCREEN = """
    b AS (SELECT c_custkey, c_nationkey AS n, c_custkey % 6 AS years, c_nationkey % 7 AS need,
                 (c_custkey >> (c_nationkey % 4)) % 2 = 1 AS must, (c_custkey >> ((c_nationkey + 1) % 4)) % 2 = 1 AS pref FROM customer),
    s AS (SELECT *, 100.0 * (2 * must::INT + 2 * (years >= need)::INT + pref::INT) / 5 AS base, (NOT must)::INT + (years < need)::INT AS miss FROM b)"""


_SCREEN_RESULT = """SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, CAST(round(base) AS INT) AS overall_match_score, 1.0::DOUBLE AS score_confidence,
           CASE WHEN base < 40 THEN 'Not Recommended' WHEN miss >= 2 THEN 'Not Recommended' WHEN base >= 75 AND miss = 0 THEN 'Shortlist' ELSE 'Review Manually' END AS recommendation,
           'INSUFFICIENT_EVIDENCE' AS authenticity_band, 'proceed' AS integrity_action
    FROM s"""


@query(f"""
    WITH {_SCREEN}
    {_SCREEN_RESULT}""", name="screen_corpus")  # fmt: skip
def screen_corpus_query(t):
    apps, docs, jds = _screening_inputs(t)
    s = screen_corpus(apps, as_layout(docs), jds, Evidence.of(t.spark), CONF)
    return results_rows(s.reports).select(
        "candidate_id", "overall_match_score", "score_confidence", "recommendation",
        "authenticity_band", "integrity_action",
    )


def _edited(t):
    """The applications, and their resumes once per edit.  A resume holds what each edit needs to change it: a list
    of skills, a figure, a known verb, two sentences and a second dated role, which adds no time of its own."""
    done = F.concat(
        F.lit("\n- Built the parts counter. Kept it going at a cost lower by "), F.col("c_custkey") % 60 + 10,
        F.lit(" percent\nClerk at Shop, 2026 - 2026"),
    )
    apps, docs, jds = _screening_inputs(t, done)
    return apps, invariance.variants(docs), jds


# the skills of p1 lend themselves to Kafka alone, and from three years on so weakly that a lack of it is no longer
# held against anybody: it leaves the score.  Figures and verbs count for nothing, later years do.
@query(f"""
    WITH {_SCREEN},
    x AS (SELECT *, NOT must AND n % 4 = 0 AND years >= 3 AS out_must, NOT pref AND (n + 1) % 4 = 0 AND years >= 3 AS out_pref FROM s),
    v AS (SELECT c_custkey, unnest([
            {{'variant': 'p1', 'base': round(100.0 * (2 * must::INT + 2 * (years >= need)::INT + pref::INT) / (5 - 2 * out_must::INT - out_pref::INT)), 'miss': miss - out_must::INT}},
            {{'variant': 'p2', 'base': round(base), 'miss': miss}},
            {{'variant': 'p3', 'base': round(base), 'miss': miss}},
            {{'variant': 'p4', 'base': round(100.0 * (2 * must::INT + 2 * (years + 5 >= need)::INT + pref::INT) / 5), 'miss': (NOT must)::INT + (years + 5 < need)::INT}}]) AS e,
            round(base) AS base, CASE WHEN base < 40 OR miss >= 2 THEN 'n' WHEN base >= 75 AND miss = 0 THEN 's' ELSE 'r' END AS label FROM x),
    w AS (SELECT e.variant AS variant, base, label, e.base AS edited,
                 CASE WHEN e.base < 40 OR e.miss >= 2 THEN 'n' WHEN e.base >= 75 AND e.miss = 0 THEN 's' ELSE 'r' END AS label_edited FROM v)
    SELECT variant, count(*) AS n, round(avg(edited - base), 6) AS mean_delta, CAST(max(base - edited) AS BIGINT) AS max_drop,
           round(avg((base = edited AND label = label_edited)::INT), 6) AS identical
    FROM w GROUP BY variant""")
def invariance_audit(t):
    apps, edited, jds = _edited(t)
    key = F.concat_ws("/", "doc_id", "variant")
    runs = edited.select(key.alias("run"), "doc_id", "variant", "text")
    apps = runs.join(apps.drop("candidate_id"), "doc_id").select(
        F.col("run").alias("candidate_id"), F.col("run").alias("doc_id"), "jd_id"
    )
    layouts = as_layout(runs.select(F.col("run").alias("doc_id"), "text"))
    s = screen_corpus(apps, layouts, jds, Evidence.of(t.spark), CONF)
    results = s.reports.select(
        F.substring_index("candidate_id", "/", 1).alias("doc_id"),
        F.substring_index("candidate_id", "/", -1).alias("variant"),
        "overall_match_score", "recommendation",
    )
    out = invariance.compare(results)
    return out.select(
        "variant", "n", F.round("mean_delta", 6).alias("mean_delta"),
        F.col("max_drop").cast("long").alias("max_drop"), F.round("identical", 6).alias("identical"),
    )
