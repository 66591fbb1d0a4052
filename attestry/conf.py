"""Thresholds and weights.  One frozen object, passed explicitly, never read from globals."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Config:
    # "Today" is always an argument so that a rerun gives the same rows.
    as_of: date = date(2026, 1, 1)

    # --- intake limits -------------------------------------------------------------------
    max_bytes: int | None = None
    jd_max_chars: int | None = None
    pasted_max_chars: int | None = None
    max_inputs: int | None = None
    file_types: tuple[str, ...] = (".txt", ".md")

    # --- integrity -----------------------------------------------------------------------
    hidden_font_pt: float = 4.0
    min_contrast: float = 1.3
    offpage_margin_pt: float = 2.0
    copy_min_run: int = 12
    copy_min_total: int = 25
    copy_high_total: int = 60
    metadata_keyword_min: int = 8
    reader_divergence: float = 0.08
    ocr_area_share: float = 0.80
    ocr_image_cover: float = 0.80
    quote_words: int = 15
    zero_width_min: int = 3
    penalties: dict[str, float] = field(
        default_factory=lambda: {"clean": 1.0, "suspicious": 0.75, "attack": 0.40}
    )

    # --- scoring -------------------------------------------------------------------------
    weight_must: float = 2.0
    weight_preferred: float = 1.0
    partial_factor: float = 0.8
    partial_default: float = 0.5
    enough_skills: int = 3
    enough_projects_or_roles: int = 1
    shortlist_min: float = 75.0
    not_recommended_max: float = 40.0
    min_score_confidence: float = 0.5
    missing_must_limit: int = 2

    # --- skill transfer --------------------------------------------------------------------
    level_very_high: float = 0.90
    level_high: float = 0.75
    level_moderate: float = 0.55
    transfer_weights: dict[str, float] = field(
        default_factory=lambda: {
            "skill_similarity": 0.25,
            "concept_overlap": 0.25,
            "experience_years": 0.10,
            "project_evidence": 0.20,
            "tech_proximity": 0.10,
            "learning_curve": 0.10,
        }
    )
    class_strong: float = 0.75
    class_moderate: float = 0.55
    class_weak: float = 0.30
    years_cap: float = 5.0
    reverse_edge_curve: float = 0.1

    # --- evidence --------------------------------------------------------------------------
    claim_weights: dict[str, float] = field(
        default_factory=lambda: {
            "PROJECT": 1.0,
            "ROLE": 1.0,
            "METRIC": 1.0,
            "CERTIFICATION": 0.8,
            "EDUCATION": 0.8,
            "SKILL": 0.6,
            "ACHIEVEMENT": 0.7,
        }
    )
    required_multiplier: float = 1.5
    alpha: float = 0.6
    beta: float = 0.3
    gamma: float = 0.1
    band_min_confidence: float = 0.40
    band_high: float = 0.75
    band_moderate: float = 0.50
    max_repos: int | None = None
    max_repos_analyzed: int | None = None
    max_commits: int | None = None
    bulk_import_ratio: float = 0.80
    bulk_import_commits: int = 2
    authorship_min: float = 0.30
    name_similarity: float = 0.85
    token_coverage: float = 2 / 3
    employer_similarity: float = 0.60
    title_similarity: float = 0.60
    title_same: float = 0.80
    date_tolerance_months: int = 2
    metric_tolerance: float = 0.02
    metric_pct_tolerance: float = 0.5
    partial_penalty: float = 0.10
    confidence_ceiling: float = 0.95
    portfolio_confidence: float = 0.30
    conflict_confidence: float = 0.7
    style_low: float = 0.33
    style_medium: float = 0.66
    readme_chars: int | None = None
    page_chars: int | None = None
    max_links: int | None = None
    max_demo_links: int | None = None
    max_headings: int | None = None
    heading_chars: int | None = None

    # --- job description / questions -------------------------------------------------------
    max_unrecognised: int | None = None
    line_chars: int | None = None
    max_gaps: int | None = None
    max_internal_gaps: int | None = None

    # --- ledger and streams ----------------------------------------------------------------
    retain_days: int = 30
    ttl_hours: int = 24
    rate_per_min: float = 10.0
    burst: float = 5.0
    # what to wait for where no rate is allowed at all
    closed_wait_s: float = 3600.0
    watermark: str = "1 hour"
    stall_gap: str = "30 minutes"


DEFAULT = Config()
