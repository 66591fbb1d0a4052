"""Queries over statuses, scores, labels, intervals and skills."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from attestry.conf import DEFAULT
from attestry.functions.dates import covered_years
from attestry.functions.skills import GRAPH
from attestry.functions.text import extract_all, raw_lines, sections, strip
from attestry.functions.titles import is_full_time
from attestry.operators import consistency, questions, requirements, resume, scoring, skills, trust
from attestry.queries.oracle import ALIASES, exact_round, lines, norm_words, values
from attestry.queries.registry import query
from attestry.sources import dims

CONF = replace(DEFAULT, as_of=date(2026, 7, 1))

# --- statuses and scores ------------------------------------------------------------------

_CLASS = """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Exact Match'
    WHEN l_returnflag = 'A' THEN 'Strongly Transferable' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Moderately Transferable'
    WHEN l_returnflag = 'N' THEN 'Weakly Transferable' ELSE 'No Evidence' END"""
_STATUS = """CASE c WHEN 'Exact Match' THEN 'Matched' WHEN 'Strongly Transferable' THEN 'Partially Matched'
    WHEN 'Moderately Transferable' THEN 'Partially Matched' WHEN 'Weakly Transferable' THEN 'Not Enough Evidence'
    ELSE CASE WHEN l_quantity >= 20 THEN 'Missing' ELSE 'Not Enough Evidence' END END"""
_MATCHED = f"""
    c AS (SELECT *, {_CLASS} AS c FROM lineitem),
    s AS (SELECT *, {_STATUS} AS status, CASE WHEN c = 'Strongly Transferable' THEN l_discount * 10 END AS score FROM c),
    v AS (SELECT *, CASE status WHEN 'Matched' THEN 1.0 WHEN 'Partially Matched' THEN coalesce(0.8 * score, 0.5)
                    WHEN 'Missing' THEN 0.0 END::DOUBLE AS value,
                 CASE WHEN l_tax < 0.05 THEN 'Must Have' ELSE 'Preferred' END AS priority,
                 'skill ' || (l_partkey % 20) AS requirement FROM s)"""


def _statuses(t):
    rows = t.lineitem.withColumn("classification", F.expr(_CLASS))
    enough = F.col("l_quantity") >= 20
    return rows.withColumn(
        "status", scoring.status_of_class(F.col("classification"), enough)
    ).withColumn(
        "partial_score",
        F.when(F.col("classification") == skills.STRONG, F.col("l_discount") * 10),
    )


@query(f"""
    WITH {_MATCHED}
    SELECT l_orderkey, l_linenumber, l_partkey, status, round(value, 6) AS value FROM v""")
def status_mapping(t):
    rows = _statuses(t)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "status",
        F.round(scoring.status_value(F.col("status"), F.col("partial_score")), 6).alias("value"),
    )


@query(f"""
    WITH {_MATCHED},
    a AS (SELECT l_orderkey, CAST(sum(CAST(CASE WHEN priority = 'Must Have' THEN 2.0 ELSE 1.0 END * value AS DECIMAL(24,6))) AS DOUBLE) AS num,
            sum(CASE WHEN value IS NOT NULL THEN CASE WHEN priority = 'Must Have' THEN 2.0 ELSE 1.0 END END)::DOUBLE AS den,
            sum(CASE WHEN value IS NULL THEN CASE WHEN priority = 'Must Have' THEN 2.0 ELSE 1.0 END END) AS miss,
            sum(CASE WHEN priority = 'Must Have' THEN 2.0 ELSE 1.0 END) AS total,
            count(CASE WHEN priority = 'Must Have' AND status = 'Missing' THEN 1 END) AS n_missing_must,
            array_to_string(list_sort(list_distinct(list(requirement) FILTER (priority = 'Must Have' AND status = 'Missing'))), '; ') AS missing_must,
            array_to_string(list_sort(list_distinct(list(requirement) FILTER (priority = 'Must Have' AND status = 'Not Enough Evidence'))), '; ') AS unresolved_must
          FROM v GROUP BY l_orderkey)
    SELECT l_orderkey, coalesce(den > 0, false) AS assessable, coalesce({exact_round("num * 100 / den", 1)}, 0.0)::DOUBLE AS base_score,
           {exact_round("1 - coalesce(miss, 0)::DOUBLE / total", 2)} AS score_confidence, n_missing_must,
           coalesce(missing_must, '') AS missing_must, coalesce(unresolved_must, '') AS unresolved_must
    FROM a""")
def compose_score(t):
    rows = _statuses(t).select(
        "l_orderkey",
        F.concat(F.lit("skill "), F.col("l_partkey") % 20).alias("requirement"),
        F.when(F.col("l_tax") < 0.05, "Must Have").otherwise("Preferred").alias("priority"),
        "status",
        "partial_score",
    )
    return scoring.compose_score(rows, ["l_orderkey"]).select(
        "l_orderkey", "assessable", "base_score", "score_confidence", "n_missing_must",
        F.array_join("missing_must", "; ").alias("missing_must"),
        F.array_join("unresolved_must", "; ").alias("unresolved_must"),
    )


@query("""
    SELECT l_orderkey, count(*) >= 3 AND count(DISTINCT l_suppkey) + count(CASE WHEN l_returnflag = 'R' THEN 1 END) >= 1 AS enough
    FROM lineitem GROUP BY l_orderkey""")
def enough_content(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        (
            F.countDistinct("l_suppkey") + F.count(F.when(F.col("l_returnflag") == "R", 1))
        ).alias("m"),
    )
    return counts.select(
        "l_orderkey", scoring.enough_content(F.col("n"), F.col("m")).alias("enough")
    )


_SCORE = "CAST(floor((c_acctbal + 1000) / 110) AS INT)"
_CONFIDENCE = "(c_custkey % 11) / 10.0"
_MISSING = "c_nationkey % 3"


@query(f"""
    WITH b AS (SELECT c_custkey, {_SCORE} AS score, {_CONFIDENCE} AS conf, {_MISSING} AS miss,
                 c_custkey % 11 > 0 AS ok, CASE c_mktsegment WHEN 'BUILDING' THEN 'flag_for_review'
                    WHEN 'MACHINERY' THEN 'disqualify_review' ELSE 'proceed' END AS action,
                 CASE WHEN c_custkey % 7 = 0 THEN 'NEEDS_VERIFICATION' WHEN c_custkey % 7 < 4 THEN 'MODERATE' END AS band FROM customer),
    f AS (SELECT *, (action <> 'proceed')::INT + (coalesce(band, '') = 'NEEDS_VERIFICATION')::INT AS forced,
                 ok AND conf >= 0.5 AS confident FROM b)
    SELECT c_custkey, CASE WHEN confident AND score < 40 THEN 'Not Recommended'
               WHEN miss >= 2 AND conf >= 0.5 THEN 'Not Recommended'
               WHEN forced > 0 THEN 'Review Manually'
               WHEN score >= 75 AND miss = 0 AND conf >= 0.5 THEN 'Shortlist' ELSE 'Review Manually' END AS label,
           CAST(CASE WHEN confident AND score < 40 THEN 1 + forced WHEN miss >= 2 AND conf >= 0.5 THEN 1 + forced
                WHEN forced > 0 THEN forced + (NOT confident)::INT
                WHEN score >= 75 AND miss = 0 AND conf >= 0.5 THEN 1
                ELSE greatest(1, (miss > 0)::INT + (NOT confident)::INT + (ok AND score < 75)::INT) END AS BIGINT) AS n_reasons
    FROM f""")
def decide_label(t):
    action = (
        F.when(F.col("c_mktsegment") == "BUILDING", "flag_for_review")
        .when(F.col("c_mktsegment") == "MACHINERY", "disqualify_review")
        .otherwise("proceed")
    )
    band = F.when(F.col("c_custkey") % 7 == 0, "NEEDS_VERIFICATION").when(
        F.col("c_custkey") % 7 < 4, "MODERATE"
    )
    rows = t.customer.select(
        "c_custkey",
        scoring.decide(
            F.expr(_SCORE),
            F.expr(_CONFIDENCE).cast("double"),
            F.col("c_custkey") % 11 > 0,
            F.expr(_MISSING),
            F.slice(F.array(F.lit("Kafka"), F.lit("Docker")), F.lit(1), F.expr(_MISSING)),
            action,
            band,
        ).alias("d"),
    )
    return rows.select(
        "c_custkey", F.col("d.label").alias("label"),
        F.size("d.reasons").cast("long").alias("n_reasons"),
    )


@query("""
    WITH b AS (SELECT doc_id, (n_chars % 101) / 100.0 AS c, (n_chars % 89) / 88.0 AS s, toxic = 1 AS forced,
                 (n_chars % 97) / 96.0 AS i FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN c < 0.4 THEN 'INSUFFICIENT_EVIDENCE' WHEN coalesce(forced, false) THEN 'NEEDS_VERIFICATION'
             WHEN s >= 0.75 THEN 'HIGH_TRUST' WHEN s >= 0.5 THEN 'MODERATE' ELSE 'NEEDS_VERIFICATION' END AS band,
           CASE WHEN i <= 0.33 THEN 'Low' WHEN i <= 0.66 THEN 'Medium' ELSE 'High' END AS style
    FROM b""")
def assign_band(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    share = lambda m: (F.col("n_chars") % m) / float(m - 1)
    return rows.select(
        "doc_id",
        trust.assign_band(
            share(101), share(89), F.coalesce(F.col("toxic") == 1, F.lit(False))
        ).alias("band"),
        trust.style_level(share(97)).alias("style"),
    )


@query("""
    SELECT c_custkey, c_name, c_mktsegment AS recommendation FROM customer
    WHERE c_mktsegment = 'BUILDING' AND contains(lower(concat_ws(' ', c_name, c_mktsegment, c_nationkey)), '00000012')""")
def search_results(t):
    rows = t.customer.withColumn("recommendation", F.col("c_mktsegment"))
    found = scoring.search_results(
        rows, label="BUILDING", needle=" 00000012 ",
        fields=["c_name", "c_mktsegment", "c_nationkey"],
    )
    return found.select("c_custkey", "c_name", "recommendation")


@query("""
    SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place
    FROM customer""")
def rank_candidates(t):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return scoring.rank_candidates(rows, "c_acctbal", "c_custkey", place="place")


@query(f"""
    WITH c AS (SELECT *, {_CLASS} AS cl,
        CASE l_linenumber WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'CORROBORATED' WHEN 3 THEN 'WEAK' WHEN 4 THEN 'UNSUPPORTED' WHEN 5 THEN 'UNVERIFIABLE' END AS st,
        CASE WHEN l_quantity < 25 THEN 'LISTED_ONLY' ELSE 'USED_IN_ROLE' END AS dep FROM lineitem),
    e AS (SELECT *, CASE WHEN cl = 'Exact Match' THEN CASE WHEN st IN ('VERIFIED','CORROBORATED') OR (st IS NULL AND dep <> 'LISTED_ONLY') THEN 'strong_evidence' ELSE 'claimed' END
                    WHEN cl = 'No Evidence' THEN 'not_demonstrated' ELSE 'transferable' END AS lv FROM c),
    d AS (SELECT *, CASE WHEN st IN ('WEAK','UNSUPPORTED','UNVERIFIABLE') AND lv IN ('strong_evidence','transferable') THEN 'claimed' ELSE lv END AS level FROM e)
    SELECT l_orderkey, l_returnflag AS skill,
           min_by(level, CASE level WHEN 'strong_evidence' THEN 3 WHEN 'transferable' THEN 2 WHEN 'claimed' THEN 1 ELSE 0 END) AS level
    FROM d GROUP BY l_orderkey, l_returnflag""")
def evidence_level(t):
    status = F.element_at(
        F.array(
            *[F.lit(s) for s in ("VERIFIED", "CORROBORATED", "WEAK", "UNSUPPORTED", "UNVERIFIABLE")],
            F.lit(None), F.lit(None), F.lit(None),
        ),
        F.least(F.col("l_linenumber"), F.lit(8)),
    )
    depth = F.when(F.col("l_quantity") < 25, "LISTED_ONLY").otherwise("USED_IN_ROLE")
    rows = t.lineitem.select(
        "l_orderkey",
        F.col("l_returnflag").alias("skill"),
        F.col("l_linenumber").alias("req_no"),
        F.lit("").alias("note"),
        F.lit("Must Have").alias("priority"),
        questions.evidence_level(F.expr(_CLASS), status, depth).alias("level"),
    )
    return questions.weakest_per_skill(rows, ["l_orderkey", "skill"]).select(
        "l_orderkey", "skill", "level"
    )


@query("""
    SELECT p_partkey, p_name AS skill, (CASE WHEN p_size < 25 THEN '0' ELSE '1' END) || '|' || p_name AS ask_order,
           CASE p_type WHEN 'SMALL' THEN 'You list ' || p_name || ' on your resume - walk me through the most recent thing you built with it and one decision you had to make along the way.'
             WHEN 'LARGE' THEN 'We use ' || p_name || ' on this team and it is not on your resume - have you run into it in coursework, a side project or informally, and how would you get up to speed?'
             ELSE 'You have adjacent experience here - where do you expect that to carry over to ' || p_name || ', and where do you expect it to break down?' END AS question
    FROM part WHERE p_type <> 'PROMO'""")
def question_plan(t):
    level = (
        F.when(F.col("p_type") == "SMALL", "claimed")
        .when(F.col("p_type") == "LARGE", "not_demonstrated")
        .when(F.col("p_type") == "PROMO", "strong_evidence")
        .otherwise("transferable")
    )
    rows = t.part.select(
        "p_partkey",
        F.col("p_name").alias("skill"),
        level.alias("level"),
        F.when(F.col("p_size") < 25, "Must Have").otherwise("Preferred").alias("priority"),
    )
    return questions.question_plan(rows).select("p_partkey", "skill", "ask_order", "question")


@query(f"""
    WITH l AS (SELECT doc_id, source, {lines("text")} AS ls FROM documents),
    c AS (SELECT doc_id, CASE WHEN contains(lower(source || ': ' || coalesce(ls[1], '')), 'rest') THEN source || ': ' || coalesce(ls[1], '') END AS p,
                 list_filter(ls[2:], lambda x: contains(lower(x), 'rest'))[1] AS q FROM l)
    SELECT doc_id, coalesce(p, q, '') AS evidence FROM c""")
def evidence_for(t):
    rows = t.spread("documents").select(
        "doc_id", "source", F.filter(F.transform(raw_lines("text"), strip), lambda x: x != "").alias("ls")
    )
    profile = rows.select(
        "doc_id",
        F.array(
            F.struct(
                F.col("source").alias("name"),
                F.coalesce(F.get("ls", F.lit(0)), F.lit("")).alias("description"),
            )
        ).alias("projects"),
        F.array(F.struct(F.slice("ls", 2, F.size("ls") + 1).alias("points"))).alias("experience"),
        F.array().cast("array<string>").alias("skills"),
    )
    return profile.select("doc_id", scoring.evidence_for(F.lit("REST")).alias("evidence"))


# --- lines, roles, intervals --------------------------------------------------------------


@query(f"""
    WITH l AS (SELECT doc_id, {lines("text")} AS ls FROM documents),
    r AS (SELECT doc_id, i, length(ls[i]) < 40 AS h FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
    g AS (SELECT doc_id, i, h, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM r)
    SELECT doc_id, CAST(sec AS BIGINT) AS section_no, CAST(count(CASE WHEN NOT h THEN 1 END) AS BIGINT) AS n_lines
    FROM g GROUP BY doc_id, sec HAVING sec > 0""")
def section_lines(t):
    rows = t.spread("documents").select(
        "doc_id",
        F.filter(F.transform(raw_lines("text"), strip), lambda x: x != "").alias("ls"),
    )
    blocks = rows.select(
        "doc_id",
        F.posexplode(
            sections(F.col("ls"), lambda x: F.when(F.length(x) < 40, F.lit("short")), "top")
        ).alias("section_no", "b"),
    )
    return blocks.where("section_no > 0").select(
        "doc_id",
        F.col("section_no").cast("long").alias("section_no"),
        F.size("b.lines").cast("long").alias("n_lines"),
    )


def _resumes(t):
    """One two-role resume per order, written out as text."""
    y = F.year("o_orderdate")
    text = F.concat(
        F.lit("Engineer who writes things\n\nWork Experience\nSenior Engineer at Org "), F.col("o_custkey"),
        F.lit(", Mar "), y, F.lit(" - "), y + 2, F.lit("\n- Built FastAPI services for "),
        F.col("o_orderkey"), F.lit(" users\n- Ran the night shift\nAnalyst | Shop "), F.col("o_custkey"),
        F.lit(" | 06/"), y + 1, F.lit(" to "),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("now")).otherwise((y + 5).cast("string")),
        F.lit("\nTechnical Skills\nLanguages: Python, Go; Docker/Kubernetes and CI/CD\nProjects\nLedger "),
        F.col("o_orderkey"), F.lit(": Kafka ledger\nEducation\nB.Sc. Computing, "), y - 1, F.lit("\n"),
    )
    return t.spread("orders").select("o_orderkey", text.alias("text"))


_ROLE_YEARS = """
    y AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders),
    r AS (SELECT *, y * 12 + 2 AS lo1, (y + 2) * 12 AS hi1, (y + 1) * 12 + 5 AS lo2,
                 CASE WHEN o_orderkey % 3 = 0 THEN 2026 * 12 + 7 ELSE (y + 5) * 12 END AS hi2 FROM y)"""


@query(f"""
    WITH {_ROLE_YEARS}
    SELECT o_orderkey, 'Engineer who writes things' AS summary,
           'CI/CD,Docker,FastAPI,Go,Kafka,Kubernetes,Python' AS skills,
           'Ledger ' || o_orderkey AS project, 'B.Sc. Computing, ' || (y - 1) AS education,
           round((hi2 - lo1) / 12.0, 2) AS total_years
    FROM r""")
def structure_resume(t):
    p = resume.structure(_resumes(t), CONF)
    return p.select(
        "o_orderkey",
        "summary",
        F.array_join("skills", ",").alias("skills"),
        F.col("projects")[0]["name"].alias("project"),
        F.col("education")[0].alias("education"),
        "total_years",
    )


@query(f"""
    WITH {_ROLE_YEARS}
    SELECT o_orderkey, CAST(n AS BIGINT) AS role_no, CASE n WHEN 0 THEN 'Senior Engineer' ELSE 'Analyst' END AS title,
           CASE n WHEN 0 THEN 'Org ' ELSE 'Shop ' END || o_custkey AS company,
           CAST(CASE n WHEN 0 THEN y ELSE y + 1 END AS VARCHAR) AS start,
           CASE n WHEN 0 THEN CAST(y + 2 AS VARCHAR) ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'present' ELSE CAST(y + 5 AS VARCHAR) END END AS "end",
           CAST(CASE n WHEN 0 THEN 3 ELSE 6 END AS BIGINT) AS start_month,
           CASE n WHEN 0 THEN 'Built FastAPI services for ' || o_orderkey || ' users; Ran the night shift' ELSE '' END AS points
    FROM r, (SELECT unnest([0, 1]) AS n)""")
def role_blocks(t):
    p = _resumes(t).select(
        "o_orderkey", F.filter(F.transform(raw_lines("text"), strip), lambda x: x != "").alias("ls")
    )
    blocks = p.withColumn("b", sections(F.col("ls"), resume.heading_key, "summary"))
    bullets = lambda x: F.regexp_replace(x, "^- ", "")
    roles = blocks.select(
        "o_orderkey",
        F.posexplode(
            resume.role_blocks(
                F.transform(
                    F.flatten(
                        F.transform(
                            F.filter("b", lambda x: x["key"] == "experience"),
                            lambda x: x["lines"],
                        )
                    ),
                    bullets,
                )
            )
        ).alias("role_no", "r"),
    )
    return roles.select(
        "o_orderkey", F.col("role_no").cast("long").alias("role_no"), "r.title", "r.company",
        "r.start", "r.end", F.col("r.start_month").cast("long").alias("start_month"),
        F.array_join("r.points", "; ").alias("points"),
    )


_SPANS = """
    m AS (SELECT o_custkey, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS lo,
                 year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 9 AS hi FROM orders)"""


def _spans(t):
    lo = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return t.orders.select(
        "o_custkey",
        F.col("o_orderkey").alias("id"),
        lo.alias("lo"),
        (lo + F.col("o_orderkey") % 9).alias("hi"),
    )


@query(f"""
    WITH {_SPANS},
    w AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM w),
    g AS (SELECT o_custkey, isl, max(hi) - min(lo) AS len FROM i GROUP BY o_custkey, isl)
    SELECT o_custkey, round(sum(len) / 12.0, 2) AS total_years FROM g GROUP BY o_custkey""")
def total_years(t):
    # per start month only the longest span matters, so a key never holds more spans than months
    longest = _spans(t).groupBy("o_custkey", "lo").agg(F.max("hi").alias("hi"))
    return longest.groupBy("o_custkey").agg(
        covered_years(F.collect_list(F.struct("lo", "hi"))).alias("total_years")
    )


@query(f"""
    WITH {_SPANS}
    SELECT a.o_custkey, a.o_orderkey AS id, count(*) AS overlaps
    FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
    WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) > 2 GROUP BY 1, 2""")
def role_overlap(t):
    return consistency.overlap_counts(_spans(t), "o_custkey").where("overlaps > 0").select(
        "o_custkey", "id", "overlaps"
    )


_TECH = [("FastAPI", 2018), ("Django", 2005), ("Kafka", 2011), ("Docker", 2013), ("React", 2013)]


@query(f"""
    WITH t AS (SELECT * FROM {values([(i, n, y) for i, (n, y) in enumerate(_TECH)], "i, tech, released", "tt")})
    SELECT o_orderkey, tech, o_orderkey % 23 AS claimed, o_orderkey % 23 > 2026 - released AS impossible
    FROM orders JOIN t ON t.i = o_custkey % 5""")
def anachronism(t):
    names = F.array(*[F.lit(n) for n, _ in _TECH])
    tech = F.get(names, (F.col("o_custkey") % 5).cast("int"))
    text = F.concat(
        F.lit("Has "), F.col("o_orderkey") % 23, F.lit(" years of hands on "), tech, F.lit(" work.")
    )
    rows = t.spread("orders").select(
        "o_orderkey", tech.alias("tech"), (F.col("o_orderkey") % 23).alias("claimed"),
        text.alias("text"),
    )
    return rows.select(
        "o_orderkey", "tech", "claimed",
        (F.size(consistency.anachronisms("text", CONF)) > 0).alias("impossible"),
    )


@query("""
    SELECT o_orderkey, CAST(year(o_orderdate) + o_orderkey % 5 AS BIGINT) AS grad,
           (o_orderkey % 4 IN (0, 1)) AND year(o_orderdate) < year(o_orderdate) + o_orderkey % 5 - 1 AS conflict
    FROM orders""")
def graduation_conflict(t):
    y = F.year("o_orderdate")
    grad = y + F.col("o_orderkey") % 5
    title = (
        F.when(F.col("o_orderkey") % 4 == 0, "Senior Engineer")
        .when(F.col("o_orderkey") % 4 == 1, "Lead Analyst")
        .when(F.col("o_orderkey") % 4 == 2, "Senior Teaching Assistant")
        .otherwise("Engineer")
    )
    rows = t.orders.select(
        "o_orderkey",
        grad.cast("long").alias("grad"),
        F.array(
            F.concat(F.lit("B.Sc. in Things, "), grad), F.concat(F.lit("Course, "), grad + 9)
        ).alias("education"),
        F.array(
            F.struct(
                title.alias("title"), y.cast("string").alias("start"), F.lit("Present").alias("end")
            )
        ).alias("roles"),
    )
    found = consistency.graduation_conflicts(F.col("education"), F.col("roles"), CONF)
    return rows.select("o_orderkey", "grad", (F.size(found) > 0).alias("conflict"))


@query("""
    SELECT p_partkey, NOT (p_size % 5 IN (0, 1, 2)) AS full_time FROM part""")
def full_time_role(t):
    title = F.concat(
        F.lit("Senior "), F.col("p_name"),
        F.when(F.col("p_size") % 5 == 0, " Intern").when(F.col("p_size") % 5 == 1, " International").otherwise(""),
    )
    company = F.when(F.col("p_size") % 5 == 2, "self-employed").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", is_full_time(title, company).alias("full_time"))


@query("""
    WITH c AS (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS f FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, round(1 - f / greatest(1, n - 2), 3) AS consistency FROM c""")
def consistency_score(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("f")
    )
    return counts.select(
        "l_orderkey",
        consistency.consistency_score(F.col("f"), F.col("n") - 2).alias("consistency"),
    )


# --- job descriptions ---------------------------------------------------------------------

_ASKED = ["Python", "FastAPI", "Kafka", "Docker", "AWS", "PostgreSQL"]
def _asked(name: str) -> str:
    rows = [(i, s, "language" if s == "Python" else "framework/tool") for i, s in enumerate(_ASKED)]
    return values(rows, "i, skill, category", name)


def _descriptions(t):
    names = F.array(*[F.lit(s) for s in _ASKED])
    first = F.get(names, (F.col("p_size") % 6).cast("int"))
    second = F.get(names, (F.col("p_partkey") % 6).cast("int"))
    text = F.concat(
        F.lit("Role\n\nMust have\n- Strong "), first,
        F.lit(" skills for production work here\n- "), F.col("p_size"),
        F.lit("+ years of professional work in a team\n- knowledge of "), F.col("p_name"),
        F.lit(" making and its long history\nPreferred\n- "), second,
        F.lit(" would be used at times\n- Bachelor degree or similar held by you now\n"
              "Benefits\n- free fruit and coffee all day\n"),
    )
    return t.spread("part").select(F.col("p_partkey").alias("jd_id"), text.alias("text"))


@query(f"""
    WITH s AS (SELECT p_partkey, p_size, a.skill AS s1, a.category AS c1, b.skill AS s2, b.category AS c2
               FROM part JOIN {_asked("a")} ON a.i = p_size % 6 JOIN {_asked("b")} ON b.i = p_partkey % 6),
    r AS (SELECT p_partkey AS jd_id, 1 AS o, s1 AS requirement, c1 AS category, 'Must Have' AS priority, NULL AS min_years FROM s
      UNION ALL SELECT p_partkey, 2, p_size || '+ years of professional experience', 'min experience', 'Must Have', p_size FROM s
      UNION ALL SELECT p_partkey, 3, s2, c2, 'Preferred', NULL FROM s WHERE s1 <> s2
      UNION ALL SELECT p_partkey, 4, 'Bachelor''s degree in a computing field', 'education', 'Preferred', NULL FROM s)
    SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY o) AS req_no, requirement, category, priority,
           CAST(min_years AS BIGINT) AS min_years FROM r""")
def requirement_scan(t):
    lines_ = requirements.description_lines(_descriptions(t))
    r = requirements.requirements(lines_)
    return r.select(
        "jd_id", F.col("req_no").cast("long").alias("req_no"), "requirement", "category",
        "priority", F.col("min_years").cast("long").alias("min_years"),
    )


@query("""
    SELECT p_partkey AS jd_id, 'knowledge of ' || p_name || ' making and its long history' AS line FROM part""")
def unrecognised_lines(t):
    lines_ = requirements.description_lines(_descriptions(t))
    return requirements.unrecognised(lines_).select("jd_id", "line")


# --- skills -------------------------------------------------------------------------------


@query(f"""
    WITH w AS (SELECT DISTINCT unnest({norm_words("text")}) AS token FROM documents)
    SELECT token, min_by(skill, CASE WHEN token = alias THEN -1 ELSE ord END) AS skill
    FROM w JOIN {ALIASES} ON token = alias OR regexp_matches(token, '\\b' || regexp_escape(alias) || '\\b')
    GROUP BY token""")
def canonical_skill(t):
    tokens = t.spread("documents").select(
        F.explode(extract_all(F.lower("text"), "[a-z0-9+#.]+")).alias("token")
    )
    return skills.canonical_tokens(tokens, dims.alias_table(t.spark))


@query("""
    SELECT o_orderkey, n_nationkey AS target, CAST(s.source AS BIGINT) AS source
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN (SELECT DISTINCT l_orderkey, n2.n_regionkey AS source FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
          JOIN nation n2 ON s_nationkey = n2.n_nationkey) s ON s.l_orderkey = o_orderkey AND s.source = n_regionkey""")
def skill_edge_join(t):
    required = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("target")
    )
    region = t.nation.select(
        F.col("n_nationkey").alias("target"), F.col("n_regionkey").cast("long").alias("source")
    )
    owned = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(region.withColumnRenamed("target", "s_nationkey"), "s_nationkey")
        .select(F.col("l_orderkey").alias("o_orderkey"), "source")
        .distinct()
    )
    return skills.edge_join(required, owned, region, keys=["o_orderkey"]).select(
        "o_orderkey", "target", "source"
    )


@query("""
    WITH w AS (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 48)
    SELECT l_suppkey, count(*) AS wanted, count(c.p_type) AS covered,
           coalesce(string_agg(CASE WHEN c.p_type IS NULL THEN w.p_type END, ',' ORDER BY w.p_type), '') AS missing
    FROM w LEFT JOIN c USING (l_suppkey, p_type) GROUP BY l_suppkey""")
def concept_gap(t):
    typed = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    wanted = typed.select("l_suppkey", "p_type").distinct()
    covered = typed.where("l_returnflag = 'R' AND l_quantity > 48").select("l_suppkey", "p_type")
    gap = skills.concept_gap(wanted, covered, keys=["l_suppkey"], concept="p_type")
    return gap.select(
        "l_suppkey", "wanted", "covered", F.array_join("missing", ",").alias("missing")
    )


@query("""
    SELECT l_orderkey, round(1 - product(1 - l_discount), 6) AS skill_similarity, round(max(l_tax), 6) AS tech_proximity,
           round(1 - min(l_quantity / 100), 6) AS learning_curve FROM lineitem GROUP BY l_orderkey""")
def transfer_factors(t):
    edges = t.lineitem.select(
        "l_orderkey",
        F.col("l_discount").alias("overlap"),
        F.col("l_tax").alias("proximity"),
        (F.col("l_quantity") / 100).alias("curve"),
    )
    f = skills.transfer_factors(edges, ["l_orderkey"])
    return f.select(
        "l_orderkey",
        *[F.round(c, 6).alias(c) for c in ("skill_similarity", "tech_proximity", "learning_curve")],
    )


@query("""
    WITH e AS (SELECT l_suppkey AS target, l_partkey AS source, min(l_discount) AS overlap, max(l_tax) AS proximity, min(l_quantity) / 50 AS curve
               FROM lineitem GROUP BY 1, 2),
    b AS (SELECT source AS target, target AS source, overlap, proximity, least(1.0, curve + 0.1) AS curve FROM e)
    SELECT target, source, round(overlap, 4) AS overlap, round(proximity, 4) AS proximity, round(curve, 4) AS curve FROM e
    UNION ALL SELECT target, source, round(overlap, 4), round(proximity, 4), round(curve, 4) FROM b WHERE (target, source) NOT IN (SELECT (target, source) FROM e)""")
def load_dims(t):
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("source")).agg(
        F.min("l_discount").alias("overlap"),
        F.max("l_tax").alias("proximity"),
        (F.min("l_quantity") / 50).alias("curve"),
    )
    s = dims.symmetric(edges)
    return s.select(
        "target", "source", *[F.round(c, 4).alias(c) for c in ("overlap", "proximity", "curve")]
    )


_OWNED = [
    ("Python", "Django", "Flask", "REST APIs"), ("MySQL", "SQL"), ("Vue",), ("Java",),
    ("Python",), ("Docker", "AWS"), ("RabbitMQ", "Kafka"), ("Flask", "SQLite", "TypeScript"),
]
_LOW = {"REST APIs": "rest apis"}


def _owned(name: str) -> str:
    rows = [(i, _LOW.get(s, s.lower())) for i, ss in enumerate(_OWNED) for s in ss]
    return values(rows, "combo, skill", name)


def _concepts(name: str) -> str:
    return values(GRAPH.concepts(), "skill, concept", name)


_EDGES_SQL = values(
    [tuple(r) for r in dims.directed_edges()], "target, source, overlap, proximity, curve", "ed"
)
_NEED = values([(i, s.lower()) for i, s in enumerate(_ASKED)], "i, target", "ne")


@query(f"""
    WITH q AS (SELECT p_partkey, p_partkey % 8 AS combo, target, p_size % 7 AS years FROM part JOIN {_NEED} ON i = p_size % 6),
    h AS (SELECT p_partkey, ow.skill, overlap, proximity, curve FROM q JOIN {_owned("ow")} ON ow.combo = q.combo
          JOIN {_EDGES_SQL} ON ed.target = q.target AND ed.source = ow.skill),
    f AS (SELECT p_partkey, round(1 - product(1 - overlap), 3) AS sim, max(proximity) AS prox, 1 - min(curve) AS learn FROM h GROUP BY p_partkey),
    cov AS (SELECT p_partkey, count(DISTINCT w.concept) AS n, count(DISTINCT g.concept) AS k FROM q JOIN {_concepts("w")} ON w.skill = q.target
            LEFT JOIN (SELECT p_partkey AS pk, concept FROM h JOIN {_concepts("co")} ON co.skill = h.skill) g ON g.pk = q.p_partkey AND g.concept = w.concept GROUP BY p_partkey),
    d AS (SELECT q.*, EXISTS (SELECT 1 FROM {_owned("o2")} WHERE o2.combo = q.combo AND o2.skill = q.target) AS direct FROM q),
    s AS (SELECT d.p_partkey, direct, sim, k, n, learn, round(0.25 * coalesce(sim, 0) + 0.25 * (CASE WHEN sim IS NULL THEN 0 ELSE k / n END) + 0.10 * least(1.0, years / 5.0)
                 + 0.10 * coalesce(prox, 0) + 0.10 * coalesce(learn, 0), 3) AS score FROM d LEFT JOIN f USING (p_partkey) LEFT JOIN cov USING (p_partkey))
    SELECT p_partkey, direct, round(coalesce(sim, 0), 3) AS skill_similarity, round(CASE WHEN sim IS NULL THEN 0 ELSE k / n END, 3) AS overlap,
           round(coalesce(learn, 0), 3) AS learning_curve,
           CASE WHEN direct THEN 'Exact Match' WHEN score >= 0.75 THEN 'Strongly Transferable' WHEN score >= 0.55 THEN 'Moderately Transferable'
                WHEN score >= 0.3 THEN 'Weakly Transferable' ELSE 'No Evidence' END AS classification
    FROM s""")
def analyze_skills(t):
    owned = F.array(*[F.array(*[F.lit(s) for s in ss]) for ss in _OWNED])
    profiles = t.spread("part").select(
        "p_partkey",
        F.get(F.array(*[F.lit(s) for s in _ASKED]), (F.col("p_size") % 6).cast("int")).alias("requirement"),
        F.get(owned, (F.col("p_partkey") % 8).cast("int")).alias("skills"),
        F.array().cast("array<struct<name:string,description:string>>").alias("projects"),
        F.array().cast("array<struct<title:string,company:string,points:array<string>>>").alias("experience"),
        (F.col("p_size") % 7).cast("double").alias("total_years"),
    )
    a = skills.analyze(resume.with_matching_columns(profiles), keep=["p_partkey"])
    return a.select(
        "p_partkey",
        "direct",
        F.col("factors.skill_similarity").alias("skill_similarity"),
        F.round("factors.concept_overlap", 3).alias("overlap"),
        F.round("factors.learning_curve", 3).alias("learning_curve"),
        "classification",
    )


_LISTED = ("Python", "Kafka", "Docker", "React", "MongoDB")


@query(f"""
    WITH p AS (SELECT p_partkey, p_size, unnest(range(0, 5)) AS i FROM part),
    s AS (SELECT p_partkey, (ARRAY{list(_LISTED)})[i + 1] AS skill FROM p WHERE (p_size >> i) & 1 = 1
          UNION SELECT p_partkey, 'Java' FROM part
          UNION SELECT p_partkey, 'MySQL' FROM part WHERE p_partkey % 2 = 0
          UNION SELECT p_partkey, 'Kafka' FROM part WHERE p_partkey % 3 = 0)
    SELECT p_partkey, string_agg(skill, ',' ORDER BY skill) AS skills FROM s GROUP BY p_partkey""")
def skill_union(t):
    bits = [F.when(F.expr(f"shiftright(p_size, {i}) & 1") == 1, F.lit(n)) for i, n in enumerate(_LISTED)]
    key = F.col("p_partkey")
    # listed, and in running text; what is named in both is one skill
    text = F.concat(
        F.lit("Skills\n"), F.array_join(F.array_compact(F.array(F.lit("Java"), *bits)), ", "),
        F.lit("\n\nExperience\nClerk at Mill, 2019 - 2021\n- Kept the ledgers"),
        F.when(key % 2 == 0, " with MySQL").otherwise(""), F.when(key % 3 == 0, " next to Kafka").otherwise(""), F.lit(" every day\n"),
    )
    found = t.spread("part").select("p_partkey", resume.profile_skills(resume.resume_sections(text)).alias("s"))
    return found.select("p_partkey", F.array_join(F.array_sort("s"), ",").alias("skills"))


@query("""
    WITH y AS (SELECT p_partkey, p_size % 8 AS years, p_size % 5 AS need, p_partkey % 4 AS e, p_partkey % 3 AS roles FROM part)
    SELECT p_partkey, CAST(n AS BIGINT) AS req_no,
           CASE n WHEN 1 THEN CASE WHEN roles = 0 THEN 'Not Enough Evidence' WHEN years >= need THEN 'Matched' ELSE 'Missing' END
                  WHEN 2 THEN CASE e WHEN 1 THEN 'Matched' WHEN 2 THEN 'Matched' ELSE 'Not Enough Evidence' END
                  ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Matched' WHEN roles > 0 THEN 'Missing' ELSE 'Not Enough Evidence' END END AS status
    FROM y, (SELECT unnest([1, 2, 3]) AS n)""")
def match_requirements(t):
    edu = F.array(
        F.array().cast("array<string>"), F.array(F.lit("B.Sc. in Law")), F.array(F.lit("Ph.D, Leeds")),
        F.array(F.lit("Diploma in Arts")),
    )
    role = F.struct(
        F.lit("Engineer").alias("title"), F.lit("Org").alias("company"),
        F.array().cast("array<string>").alias("points"),
    )
    reqs = F.array(
        *[
            F.struct(
                F.lit(i).alias("req_no"), F.lit(r).alias("requirement"), F.lit(s).alias("skill"),
                F.lit(c).alias("category"), F.lit("Must Have").alias("priority"),
                (F.col("p_size") % 5).cast("int").alias("min_years"),
            )
            for i, r, s, c in (
                (1, "years", None, "min experience"),
                (2, "degree", None, "education"),
                (3, "Kafka", "kafka", "framework/tool"),
            )
        ]
    )
    base = F.array(F.lit("Java"), F.lit("Go"), F.lit("Vue"))
    profiles = t.spread("part").select(
        "p_partkey", "p_size",
        F.when(F.col("p_partkey") % 2 == 0, F.concat(base, F.array(F.lit("Kafka")))).otherwise(base).alias("skills"),
        F.array().cast("array<struct<name:string,description:string>>").alias("projects"),
        F.slice(F.array(role, role), F.lit(1), (F.col("p_partkey") % 3).cast("int")).alias("experience"),
        F.get(edu, (F.col("p_partkey") % 4).cast("int")).alias("education"),
        (F.col("p_size") % 8).cast("double").alias("total_years"),
    )
    pairs = resume.with_matching_columns(profiles).withColumn("q", F.explode(reqs)).select("*", "q.*")
    m = scoring.match_requirements(pairs, CONF, keep=["p_partkey"])
    return m.select("p_partkey", F.col("req_no").cast("long").alias("req_no"), "status")


