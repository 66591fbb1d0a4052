"""The skill graph as expressions and as dimension rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import lexicons as L
from attestry.conf import DEFAULT, Config
from attestry.functions.text import extract_all, fixed, let, lookup, norm_words, strip


@dataclass(frozen=True)
class SkillGraph:
    """A small, versioned dimension: names, spellings, concepts and one-hop edges."""

    skills: dict = field(default_factory=lambda: L.SKILLS)
    edges: tuple = L.SKILL_EDGES
    display: dict = field(default_factory=lambda: L.SKILL_DISPLAY)

    def aliases(self) -> list[tuple[str, int, str]]:
        """(spelling, ordinal, skill) in graph order."""
        pairs = [(a, name) for name, node in self.skills.items() for a in (name, *node[0])]
        return [(a, i, name) for i, (a, name) in enumerate(pairs)]

    def concepts(self) -> list[tuple[str, str]]:
        return [(name, c) for name, node in self.skills.items() for c in node[2]]

    def max_words(self) -> int:
        return max(len(re.findall(r"\w+", a)) for a, _, _ in self.aliases())


GRAPH = SkillGraph()


def phrases(c: Column, max_words: int, *, word: str = r"\w") -> Column:
    """Every run of up to `max_words` words with what stands between them, as written.

    `word` is the inside of the character class words are made of.
    """

    def runs(pieces: Column, span: int) -> Column:
        starts = F.filter(
            F.transform(pieces, lambda _, i: i + 1), lambda i: i + (span - 1) <= F.size(pieces)
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, span), ""))

    return let(
        extract_all(c, f"(?U)[{word}]+|[^{word}]+"),
        lambda ps: F.flatten(F.array(*[runs(ps, 2 * n - 1) for n in range(1, max_words + 1)])),
    )


def canonical(c: Column, graph: SkillGraph = GRAPH) -> Column:
    """J1 as an expression: exact spelling first, else the first spelling in graph order that
    stands at word boundaries inside the text; NULL when none does."""
    ordinals = {a: i for a, i, _ in graph.aliases()}
    spellings = list(ordinals)
    by_ordinal = fixed([s for _, _, s in graph.aliases()])

    def resolve(low: Column) -> Column:
        inside = F.array_min(
            F.transform(phrases(low, graph.max_words()), lambda p: lookup(ordinals, p))
        )
        # Most words are no skill: a hashed membership test settles those without touching the
        # map, and only text with something between words can hold a spelling inside it.
        exact = F.when(low.isin(*spellings), lookup(ordinals, low))
        return F.get(by_ordinal, F.coalesce(exact, F.when(low.rlike(r"(?U)\W"), inside)))

    return let(F.lower(strip(c)), resolve)


def is_alias(c: Column, graph: SkillGraph = GRAPH) -> Column:
    return F.lower(strip(c)).isin(*[a for a, _, _ in graph.aliases()])


def display_name(skill: Column, graph: SkillGraph = GRAPH) -> Column:
    return F.coalesce(lookup(graph.display, skill), F.initcap(skill))


def jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard of two strings; 0 when either has no token."""

    def overlap(ta: Column, tb: Column) -> Column:
        both, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
        return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(both / union)

    return let(norm_words(a), lambda ta: let(norm_words(b), lambda tb: overlap(ta, tb)))


def semantic_level(score: Column, conf: Config = DEFAULT) -> Column:
    return (
        F.when(score >= conf.level_very_high, "Very High")
        .when(score >= conf.level_high, "High")
        .when(score >= conf.level_moderate, "Moderate")
        .otherwise("Low")
    )
