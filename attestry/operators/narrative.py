"""M7: generated prose against the facts it was written from.

Prose is cut into clauses, clauses into mentions, and every rule is a condition on one mention
row; the only shuffle is the final removal of duplicate violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import lexicons as L
from attestry.functions.skills import GRAPH, SkillGraph, canonical
from attestry.functions.text import NOT_S, extract_all, lookup, rx

_BEFORE = r"(?<![\w+#./-])"
_AFTER = r"(?![\w+#]|\.\w)"


def _vocabulary(graph: SkillGraph) -> dict[str, str]:
    return {
        a: s for a, _, s in graph.aliases() if a not in L.AMBIGUOUS_TERMS and len(a) >= 2
    }


def _quote(term: Column | str) -> Column:
    return F.concat(F.lit(r"\Q"), F.lit(term) if isinstance(term, str) else term, F.lit(r"\E"))


def _term_pattern(graph: SkillGraph, extra: Column | None) -> Column:
    """Longest terms first; `extra` holds whole requirement texts of the same row."""
    known = sorted(_vocabulary(graph), key=len, reverse=True)
    static = F.lit("|".join(rf"\Q{t}\E" for t in known))
    if extra is None:
        body = static
    else:
        own = F.array_join(F.transform(extra, _quote), "|")
        body = F.when(F.size(extra) > 0, F.concat(own, F.lit("|"), static)).otherwise(static)
    # each match starts where the last one ended: else the end of a text, where no term follows,
    # is searched again from each of its characters
    return F.concat(
        F.lit(r"(?Ud)\G((?s:.)*?)" + _BEFORE + "("), body, F.lit(")" + _AFTER)
    )


def _key(term: Column, graph: SkillGraph) -> Column:
    return F.coalesce(lookup(_vocabulary(graph), term), term)


def fact_keys(items: Column, graph: SkillGraph = GRAPH) -> Column:
    """Every key a list of requirement texts stands for."""
    spelled = {a: [a, s] for a, s in _vocabulary(graph).items()}

    def keys(low: Column) -> Column:
        inside = F.transform(
            F.regexp_extract_all(low, _term_pattern(graph, None), F.lit(2)),
            lambda t: _key(t, graph),
        )
        short = F.size(extract_all(low, NOT_S + "+")) <= 3
        name = F.when(short, canonical(low, graph))
        found = F.array_compact(F.concat(F.array(low, name), inside))
        # a text that is a spelling itself holds that one and no other
        return F.coalesce(F.when(low.isin(*spelled), lookup(spelled, low)), found)

    lows = F.transform(items, lambda r: F.lower(F.trim(r)))
    return F.array_distinct(F.flatten(F.transform(lows, keys)))


def _clauses(text: Column) -> Column:
    sentences = F.split(text, L.SENTENCE_BREAK)
    return F.filter(
        F.flatten(F.transform(sentences, lambda s: F.split(s, rx(L.CLAUSE_BREAK)))),
        lambda c: F.trim(c) != "",
    )


def _pieces(field: str, texts: Column) -> Column:
    return F.transform(
        texts, lambda t: F.struct(F.lit(field).alias("field"), t.alias("text"))
    )


def check_narratives(
    narratives: DataFrame, facts: DataFrame, graph: SkillGraph = GRAPH, *, key: str = "doc_id"
) -> DataFrame:
    """Violations (key, type, detail, severity).  No row means the prose fits the facts.

    facts(key, matched, missing, partial, base_score, total_requirements);
    narratives(key, summary, rationale, strengths, risks).
    """
    none = F.array().cast("array<string>")
    keyed = facts.select(
        key,
        *[
            fact_keys(F.coalesce(c, none), graph).alias(f"_{c}")
            for c in ("matched", "missing", "partial")
        ],
        F.filter(
            F.transform(
                F.concat(
                    F.coalesce("matched", none),
                    F.coalesce("missing", none),
                    F.coalesce("partial", none),
                ),
                lambda r: F.lower(F.trim(r)),
            ),
            lambda r: r.rlike(NOT_S + r"\s+\S"),
        ).alias("_whole"),
        F.size(F.coalesce("matched", none)).alias("_n_matched"),
        F.size(F.coalesce("missing", none)).alias("_n_missing"),
        "base_score",
        "total_requirements",
    )
    rows = narratives.join(keyed, key).withColumn(
        "_whole",
        F.transform(
            F.array_sort(
                F.transform("_whole", lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))
            ),
            lambda x: x["r"],
        ),
    )
    prose = F.array_compact(F.array("summary", "rationale"))
    strengths, risks = F.coalesce("strengths", none), F.coalesce("risks", none)
    found = (
        _skill_rules(rows, prose, strengths, risks, key, graph)
        .unionByName(_number_rules(rows, prose, key))
        .unionByName(_wording_rules(rows, F.concat(prose, strengths, risks), key))
    )
    return found.distinct()


def _skill_rules(
    rows: DataFrame, prose: Column, strengths: Column, risks: Column, key: str, graph: SkillGraph
) -> DataFrame:
    parts = F.concat(
        _pieces("strength", F.filter(strengths, lambda s: ~s.rlike(rx(L.NEGATION_CUE)))),
        _pieces(
            "risk",
            F.filter(
                F.flatten(F.transform(risks, _clauses)), lambda c: c.rlike(rx(L.GAP_CUE))
            ),
        ),
        _pieces("prose", F.flatten(F.transform(prose, _clauses))),
    )
    clauses = rows.select(
        key, "_matched", "_missing", "_partial", "_whole", F.explode(parts).alias("p")
    ).withColumn("_low", F.lower("p.text"))
    pattern = _term_pattern(graph, F.col("_whole"))
    mentions = (
        # exploded from inside a struct: an exploded column gets a filter on its size, which would
        # search every clause a second time
        clauses.withColumn(
            "_found",
            F.struct(
                F.regexp_extract_all("_low", pattern, F.lit(1)).alias("gaps"),
                F.regexp_extract_all("_low", pattern, F.lit(2)).alias("terms"),
            ),
        )
        .select(
            key, "_matched", "_missing", "_partial", F.col("p.field").alias("field"), "_found",
            F.posexplode("_found.terms").alias("_i", "term"),
        )
        .withColumn("_gaps", F.col("_found.gaps"))
        .withColumn("_terms", F.col("_found.terms"))
        .withColumn(
            "_before",
            F.array_join(
                F.flatten(
                    F.transform(
                        F.slice(F.arrays_zip("_gaps", "_terms"), F.lit(1), F.col("_i") + 1),
                        lambda z, i: F.when(
                            i < F.col("_i"), F.array(z["_gaps"], z["_terms"])
                        ).otherwise(F.array(z["_gaps"])),
                    )
                ),
                "",
            ),
        )
        .withColumn("skill", _key(F.col("term"), graph))
    )
    has = lambda c: F.array_contains(c, F.col("skill"))
    matched, missing, partial = has("_matched"), has("_missing"), has("_partial")
    nowhere = ~matched & ~missing & ~partial
    known = F.col("skill").isin(*graph.skills)
    cue = lambda p: F.col("_before").rlike(rx(p))
    field = F.col("field")
    kind = (
        F.when(
            (field == "strength") & missing & ~matched, "strength_contradicts_facts"
        )
        .when((field == "risk") & matched & ~missing & ~partial, "risk_contradicts_facts")
        .when(
            (field == "prose") & missing & ~matched
            & cue(L.POSITIVE_CUE) & ~cue(L.NEGATION_CUE),
            "strength_contradicts_facts",
        )
        .when(
            (field == "prose") & matched & ~missing & cue(L.GAP_CUE), "risk_contradicts_facts"
        )
        .when(nowhere & known, "unknown_skill")
    )
    return (
        mentions.withColumn("type", kind)
        .where(F.col("type").isNotNull())
        .select(
            key,
            "type",
            F.concat(F.lit("'"), "term", F.lit("' in "), field).alias("detail"),
            F.when(F.col("type") == "unknown_skill", "low").otherwise("high").alias("severity"),
        )
    )


def _number(c: Column) -> Column:
    return F.coalesce(lookup(L.NUMBER_WORDS, F.lower(c)), c.try_cast("int"))


def _number_rules(rows: DataFrame, prose: Column, key: str) -> DataFrame:
    texts = rows.select(
        key, "base_score", "total_requirements", "_n_matched", "_n_missing",
        F.explode(prose).alias("t"),
    )
    base, total = F.col("base_score"), F.col("total_requirements").cast("int")
    scores = F.concat(
        extract_all("t", rx(L.SCORE_MENTION), 1), extract_all("t", rx(L.OUT_OF_100), 1)
    )
    wrong_scores = F.transform(
        F.filter(scores, lambda s: F.abs(s.try_cast("double") - base) > 0.5),
        lambda s: F.struct(
            F.lit("score_mismatch").alias("type"),
            F.concat(F.lit("prose states a score of "), s).alias("detail"),
        ),
    )
    allowed = F.array(
        total, F.col("_n_matched"), F.col("_n_missing"),
        total - F.col("_n_missing"), total - F.col("_n_matched"),
    )
    pairs = F.arrays_zip(
        extract_all("t", rx(L.N_OF_M), 1).alias("n"), extract_all("t", rx(L.N_OF_M), 2).alias("m")
    )
    wrong_pairs = F.transform(
        F.filter(
            pairs,
            lambda p: (_number(p["m"]) != total) | ~F.array_contains(allowed, _number(p["n"])),
        ),
        lambda p: F.struct(
            F.lit("count_mismatch").alias("type"),
            F.concat(
                F.lit("prose says "), p["n"], F.lit(" of "), p["m"], F.lit(" requirements")
            ).alias("detail"),
        ),
    )
    wrong_totals = F.transform(
        F.filter(extract_all("t", rx(L.TOTAL_COUNT), 1), lambda n: _number(n) != total),
        lambda n: F.struct(
            F.lit("count_mismatch").alias("type"),
            F.concat(F.lit("prose says "), n, F.lit(" requirements")).alias("detail"),
        ),
    )
    return texts.select(
        key, F.explode(F.concat(wrong_scores, wrong_pairs, wrong_totals)).alias("v")
    ).select(key, "v.type", "v.detail", F.lit("high").alias("severity"))


def _wording_rules(rows: DataFrame, texts: Column, key: str) -> DataFrame:
    each = rows.select(key, F.explode(texts).alias("t"))
    tests = F.array(
        *[
            F.struct(
                F.lit(kind).alias("type"), F.regexp_extract("t", rx(p), 0).alias("hit")
            )
            for kind, p in (
                ("accusatory_language", L.GUILT_CUE),
                ("hiring_decision", L.DECISION_CUE),
            )
        ]
    )
    return (
        each.select(key, F.explode(tests).alias("v"))
        .where("v.hit <> ''")
        .select(
            key,
            "v.type",
            F.concat(F.lit("wording '"), "v.hit", F.lit("'")).alias("detail"),
            F.lit("high").alias("severity"),
        )
    )


