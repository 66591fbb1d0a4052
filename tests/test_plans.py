"""Whole plans on hand-written candidates: labels, invariants, determinism."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from attestry.conf import Config
from attestry.plans import invariance
from attestry.plans.assess import SCHEMAS, Evidence
from attestry.plans.screen import screen_corpus
from attestry.sources.corpus import as_layout

CONF = Config(as_of=date(2026, 7, 1))
JD = """Timetable Portal Developer (regional railway)

Requirements
* React for the passenger pages
* Everyday TypeScript
* MongoDB as the store of departures
* Kafka to carry delay messages
* 2+ years of professional experience with web portals
* Bachelor's degree in Computer Science

Nice to have
* GCP
"""
STRONG = """Robin Vale
robin@vale.example

Employment
Senior Portal Developer at Lowland Rail Works, 2020 - Present
* Rewrote the departure boards in React and TypeScript, reducing load time by 45 percent
* Moved delay messages to Kafka. Keeps departures in MongoDB.
Portal Developer at Tidewater Ferries, 2017 - 2020
* Kept the TypeScript booking pages alive

Skills
React, TypeScript, MongoDB, Kafka, GCP

Projects
Platform Board: React pages that show where a train leaves

Education
B.Sc. Computer Science, 2017
"""
TRANSFER = STRONG.replace("React", "Angular").replace("Kafka", "RabbitMQ").replace(", GCP", "")
BRIEF = "Kim Short\nkim@short.example\n\nSkills\nTypeScript\n"
PADDED = STRONG.replace(
    "Kept the TypeScript booking pages alive", "Passionate, dynamic, world-class visionary synergy"
)


def screen(spark, texts, evidence=None):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    apps = docs.select(F.col("doc_id").alias("candidate_id"), "doc_id", F.lit(1).alias("jd_id"))
    jds = spark.createDataFrame([(1, JD)], "jd_id int, text string")
    tables = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in (evidence or {}).items()}
    return screen_corpus(apps, as_layout(docs), jds, Evidence.of(spark, **tables), CONF)


EVIDENCE = {
    "listing": [
        ("flagged", "platform-board", False, "2021-03-01", "2025-02-01", ["react"], "main", "", "TypeScript"),
        ("flagged", "todo-course", True, "2019-05-02", "2019-05-01", [], "main", "a freecodecamp tutorial", ""),
    ],
    "languages": [("flagged", "platform-board", "TypeScript", 52000)],
    "paths": [("flagged", "platform-board", "package.json"), ("flagged", "platform-board", "src/board.tsx")],
    "manifests": [("flagged", "platform-board", "package.json", '{"dependencies": {"react": "18", "mongodb": "6"}}')],
    "commits": [("flagged", "platform-board", i, "flagged" if i < 27 else "y") for i in range(30)],
    "readmes": [("flagged", "platform-board", "Where a train leaves. It is reducing load time by 45 percent.")],
    "external": [("flagged", "ok", 0, "Senior Portal Developer", "Lowland Rail Works", "2023", "Present")],
    "sources": [("flagged", "robin", None, None, None)],
}


@pytest.fixture(scope="module")
def results(spark):
    texts = {"strong": STRONG, "transfer": TRANSFER, "brief": BRIEF, "padded": PADDED, "flagged": STRONG}
    s = screen(spark, texts, EVIDENCE)
    reports = {r.candidate_id: r for r in s.reports.collect()}
    claims = {}
    for r in s.assessment.claims.collect():
        claims.setdefault(r.candidate_id, {})[(r.type, r.text)] = r
    flags = {(r.candidate_id, r.flag) for r in s.assessment.flags.collect()}
    return reports, claims, flags


def test_labels(results):
    reports = results[0]
    assert (reports["strong"].recommendation, reports["strong"].overall_match_score) == ("Shortlist", 100)
    assert reports["brief"].recommendation == "Review Manually"
    status = {m.requirement: m.status for m in reports["transfer"].requirement_match}
    assert status["React"] == "Partially Matched"


def test_missing_evidence_lowers_confidence_not_the_score(results):
    reports = results[0]
    assert reports["strong"].authenticity.band == "INSUFFICIENT_EVIDENCE"
    assert reports["strong"].overall_match_score == reports["flagged"].overall_match_score


def test_style_moves_nothing_that_counts(results):
    a, b = results[0]["strong"], results[0]["padded"]
    assert (a.overall_match_score, a.recommendation, a.authenticity.band) == (
        b.overall_match_score, b.recommendation, b.authenticity.band,
    )
    assert b.authenticity.inflation_index > a.authenticity.inflation_index


def test_evidence_reaches_the_claims(results):
    claims = results[1]["flagged"]
    assert claims["SKILL", "TypeScript"].status == "VERIFIED"
    assert claims["SKILL", "React"].status == "VERIFIED"
    assert claims["SKILL", "GCP"].status == "UNSUPPORTED"
    # the export starts the role three years later than the resume does
    role = claims["ROLE", "Senior Portal Developer"]
    assert (role.status, role.confidence) == ("CONTRADICTED", 0.7)
    board = next(c for (kind, text), c in claims.items() if kind == "METRIC" and "load time" in text)
    assert board.status == "VERIFIED"
    assert results[0]["flagged"].authenticity.band == "NEEDS_VERIFICATION"


def test_forks_nobody_relies_on_are_not_reported(results):
    assert not any(flag == "fork_claimed_as_own" for _, flag in results[2])


def test_truthful_rewording_and_repeats_change_nothing(spark):
    docs = spark.createDataFrame([("a", STRONG), ("b", TRANSFER)], "doc_id string, text string")
    names = ("primary", "p3")
    rows = invariance.variants(docs, names=names).collect()
    texts = {f"{r.doc_id}/{r.variant}": r.text for r in rows}
    outs = []
    for _ in range(2):
        got = screen(spark, texts).reports.collect()
        outs.append({r.candidate_id: (r.overall_match_score, r.recommendation) for r in got})
    assert outs[0] == outs[1]
    for d in ("a", "b"):
        assert outs[0][f"{d}/primary"] == outs[0][f"{d}/p3"]
