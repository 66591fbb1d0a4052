"""M5: claims of many candidates judged against what was collected about them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.conf import DEFAULT, Config
from attestry.functions.rounding import round_even
from attestry.functions.skills import GRAPH, SkillGraph
from attestry.operators import claims as C
from attestry.operators import consistency as K
from attestry.operators import judging as J
from attestry.operators import repo_evidence as R
from attestry.operators import trust as T
from attestry.session import by_merge, cut_lineage
from attestry.sources.repos import read_listing

SCHEMAS = {
    "listing": "candidate_id string, name string, fork boolean, created_at string, "
    "pushed_at string, topics array<string>, default_branch string, description string, "
    "language string",
    "languages": "candidate_id string, name string, language string, bytes bigint",
    "paths": "candidate_id string, name string, path string",
    "manifests": "candidate_id string, name string, file string, content string",
    "commits": "candidate_id string, name string, commit_no int, author_login string",
    "readmes": "candidate_id string, name string, text string",
    "external": "candidate_id string, status string, role_no int, title string, "
    "company string, start string, end string",
    "pages": "candidate_id string, status string, url string, tech array<string>",
    "sources": "candidate_id string, username string, consent_github boolean, "
    "consent_linkedin boolean, consent_portfolio boolean",
}


@dataclass
class Evidence:
    """Collected tables, all keyed by candidate_id.  Absent tables are simply empty."""

    listing: DataFrame
    languages: DataFrame
    paths: DataFrame
    manifests: DataFrame
    commits: DataFrame
    readmes: DataFrame
    external: DataFrame
    pages: DataFrame
    sources: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Evidence:
        return cls(
            **{
                name: tables.get(name, spark.createDataFrame([], schema))
                for name, schema in SCHEMAS.items()
            }
        )


@dataclass
class Assessment:
    summary: DataFrame
    claims: DataFrame
    findings: DataFrame
    gaps: DataFrame
    flags: DataFrame
    repos: DataFrame


def _with_consent(ev: Evidence) -> tuple[DataFrame, ...]:
    """Drop what a candidate refused before anything reads it."""

    def allowed(df: DataFrame, which: str) -> DataFrame:
        refused = ev.sources.where(f"consent_{which} = false").select("candidate_id")
        return df.join(by_merge(refused), "candidate_id", "left_anti")

    return (
        allowed(ev.listing, "github"),
        allowed(ev.external, "linkedin"),
        allowed(ev.pages, "portfolio"),
    )


def assess(
    profiles: DataFrame, required: DataFrame, ev: Evidence, conf: Config = DEFAULT,
    graph: SkillGraph = GRAPH, *, stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Assessment:
    """profiles(candidate_id, text, profile columns), required(candidate_id, requirement).

    `stage` materialises what several branches read, which keeps the plan a chain of short
    steps and each text and each repository processed once.
    """
    key = "candidate_id"
    listing, external, pages = _with_consent(ev)

    needed = (
        required.select(key, F.lower("requirement").alias("_low"))
        .distinct()
        .withColumn("_req", F.lit(True))
    )
    claims = stage(
        C.extract_claims(profiles, keys=[key])
        .withColumn("_low", F.lower("text"))
        .join(by_merge(needed), [key, "_low"], "left")
        .withColumn(
            "required", F.coalesce(F.col("_req"), F.lit(False)) & (F.col("type") == "SKILL")
        )
        .drop("_low", "_req")
    )
    skill_claims = claims.where("type = 'SKILL'")

    # which repositories are examined, and what they show
    wanted = stage(
        R.skill_terms(
            skill_claims.select(key, "text")
            .unionByName(required.select(key, F.col("requirement").alias("text")))
            .distinct(),
            graph,
        )
        .select(key, "canon", "key")
        .distinct()
    )
    repos = stage(
        R.repo_profile(
            read_listing(listing, conf), ev.paths, ev.languages, ev.commits, ev.readmes,
            ev.manifests, conf, mine=_own_commit(ev),
        )
    )
    shown = stage(R.skill_evidence(repos, graph))
    ranked = R.rank_repos(repos, R.listing_relevance(repos, wanted, graph), conf)
    examined = stage(
        R.mark_examined(
            stage(ranked), stage(R.coverage(wanted, shown, keys=[key, "canon"])), wanted, conf
        )
    )
    accounts = stage(
        ev.sources.select(key, "username").join(by_merge(R.account_status(examined)), key, "left")
    )

    # verdicts
    by_claim = R.coverage(
        R.skill_terms(skill_claims.select(key, "claim_no", "text"), graph), shown,
        keys=[key, "claim_no"],
    )
    roles = profiles.select(key, F.posexplode("experience").alias("role_no", "r")).select(
        key, "role_no", "r.title", "r.company", "r.start", "r.end"
    )
    matched = K.best_employer(roles, external.where("status = 'ok' AND role_no IS NOT NULL"), conf)
    conflicts = stage(K.external_conflicts(matched, conf))

    def of(kind: str) -> DataFrame:
        return claims.where(F.col("type") == kind)

    verdicts = (
        J.judge_skills(skill_claims, by_claim, examined, accounts, pages, conf)
        .unionByName(J.judge_projects(of("PROJECT"), examined, accounts, conf))
        .unionByName(J.judge_roles(of("ROLE"), external, conflicts, conf))
        .unionByName(J.judge_metrics(of("METRIC"), examined, accounts, conf))
        .unionByName(
            J.judge_rest(
                claims.where("type IN ('ACHIEVEMENT', 'EDUCATION', 'CERTIFICATION')")
            )
        )
    )
    judged = stage(
        claims.join(by_merge(verdicts), [key, "claim_no"])
        .withColumn("epistemic_tag", T.epistemic_tag(F.col("status")))
        .withColumn(
            "weight", round_even(T.claim_weight(F.col("type"), F.col("required"), conf), 3)
        )
    )

    # findings and scores
    internal = stage(
        K.with_internal_findings(profiles, conf).select(
            key, "findings", "internal_checks", F.size("experience").alias("n_roles")
        )
    )
    findings = K.all_findings(internal, conflicts, key=key)
    located = J.locate_findings(
        internal.select(key, F.posexplode("findings").alias("finding_no", "f")).select(
            key, "finding_no", "f.*"
        ),
        claims,
    )
    summary = _summary(
        profiles, claims, judged, internal, conflicts, external, pages, ev, examined, accounts,
        conf,
    )
    projects = profiles.select(key, F.explode("projects.name").alias("project"))
    flags = J.cited_repo_flags(examined, judged, claims, projects, accounts, conf)
    return Assessment(
        summary=summary,
        claims=judged,
        findings=findings,
        gaps=T.verification_gaps(judged, located, conf, keys=[key]),
        flags=flags,
        repos=examined,
    )


def _own_commit(ev: Evidence) -> Column:
    # commits carry the login they were made with; the account name is on the same row
    if "username" in ev.commits.columns:
        return F.col("author_login") == F.col("username")
    return F.col("author_login") == F.col("candidate_id")


def _summary(
    profiles, claims, judged, internal, conflicts, external, pages, ev, examined, accounts, conf
) -> DataFrame:
    key = "candidate_id"
    roll = T.claim_rollup(judged, [key], conf)
    style = C.inflation_signals(profiles, claims, conf, keys=[key])
    n_conflicts = conflicts.groupBy(key).agg(F.count(F.lit(1)).alias("n_conflicts"))
    exports = external.groupBy(key).agg(F.min("status").alias("_export"))
    web = pages.groupBy(key).agg(F.min("status").alias("_page"), F.lit(True).alias("_has_page"))
    base = (
        internal.select(
            key, F.size("findings").alias("n_internal"), "internal_checks", "n_roles"
        )
        .join(by_merge(roll), key, "left")
        .join(by_merge(style), key, "left")
        .join(by_merge(n_conflicts), key, "left")
        .join(by_merge(exports), key, "left")
        .join(by_merge(web), key, "left")
        .join(by_merge(ev.sources), key, "left")
        .join(
            by_merge(accounts.select(key, "account", "n_examined")),
            key,
            "left",
        )
        .fillna(0, ["n_conflicts", "n_claims", "n_examined"])
    )
    status = R.source_status
    named = F.col("username").isNotNull()
    staged = (
        base.withColumn("github", status(F.col("consent_github"), named, F.col("account")))
        .withColumn(
            "linkedin",
            status(F.col("consent_linkedin"), F.col("_export").isNotNull(), F.col("_export")),
        )
        .withColumn(
            "portfolio",
            status(F.col("consent_portfolio"), F.col("_has_page"), F.col("_page")),
        )
    )
    partly = (F.col("account") == "partial") & (F.col("n_examined") > 0)
    n_sources = sum(
        (F.when(F.col(s) == "ok", 1).otherwise(0) for s in ("github", "linkedin", "portfolio")),
        F.when(F.coalesce(partly, F.lit(False)), 1).otherwise(0),
    )
    checks = F.col("internal_checks") + F.when(
        F.col("linkedin") == "ok", F.col("n_roles")
    ).otherwise(0)
    zero, half = F.lit(0.0), F.lit(0.5)
    scored = (
        staged.withColumn("n_sources", n_sources)
        .withColumn(
            "consistency",
            K.consistency_score(F.col("n_internal") + F.col("n_conflicts"), checks),
        )
        .withColumn("coverage", F.coalesce("coverage", zero))
        .withColumn("reliability", F.coalesce("reliability", half))
        .withColumn("mean_confidence", F.coalesce("mean_confidence", zero))
        .withColumn(
            "assessment_confidence",
            T.assessment_confidence(
                F.col("coverage"), F.col("n_sources"), F.col("mean_confidence")
            ),
        )
        .withColumn(
            "authenticity",
            T.displayed_score(
                F.col("reliability"), F.col("consistency"), F.col("inflation_index"), conf
            ),
        )
        .withColumn(
            "band_score", T.band_score(F.col("reliability"), F.col("consistency"), conf)
        )
        .withColumn(
            "contradicted",
            F.coalesce("claim_contradicted", F.lit(False)) | (F.col("n_conflicts") > 0),
        )
    )
    return scored.select(
        key,
        T.assign_band(
            F.col("assessment_confidence"), F.col("band_score"), F.col("contradicted"), conf
        ).alias("band"),
        "authenticity",
        "reliability",
        "consistency",
        "coverage",
        "inflation_index",
        "assessment_confidence",
        "band_score",
        F.struct(
            "buzzword_density",
            "specificity_gap",
            "skill_list_bloat",
            "unanchored_metrics",
            "opener_repetition",
        ).alias("inflation_signals"),
        F.struct("github", "linkedin", "portfolio").alias("sources"),
        "n_sources",
        "n_claims",
        (F.col("n_internal") + F.col("n_conflicts")).alias("n_contradictions"),
        T.style_level(F.col("inflation_index"), conf).alias("style_level"),
    )
