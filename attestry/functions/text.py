"""Text helpers as Column expressions.

Everything stays inside one row: a document is split, labelled and sliced with higher-order
functions, so none of these helpers shuffles and a long document costs only its own task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry import lexicons as L
from attestry.functions.rounding import round_even

RARE_BREAK = "[\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
LINE_BREAK = "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
WORD = r"[a-z0-9+#.]+"
# Unicode white space: as characters to trim, and as patterns.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
S = r"(?U)[\s\x1C-\x1F]"
NOT_S = r"(?U)\S"


def rx(
    pattern: str, *, fold: bool = True, multiline: bool = False, unicode: bool = True
) -> str:
    """Add the flags every pattern here needs: Unicode classes, newline-only `.` and `$`."""
    return f"(?d{'U' if unicode else ''}{'i' if fold else ''}{'m' if multiline else ''}){pattern}"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def by_script(c: Column, build: Callable[[bool], Column]) -> Column:
    """Unicode-aware patterns are slow; pure ASCII rows take the same pattern without the flag.

    `c` should be a plain column, since it appears in both branches.
    """
    return F.when(is_ascii(c), build(False)).otherwise(build(True))


def replace_all(
    c: Column | str, pattern: str, to: str, *, fold: bool = True, multiline: bool = False
) -> Column:
    x = col(c)
    return by_script(
        x,
        lambda u: F.regexp_replace(x, rx(pattern, fold=fold, multiline=multiline, unicode=u), to),
    )


def any_of(patterns: Iterable[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times in `body`.

    Column objects are trees, so reusing one in several places copies it; a lambda variable keeps
    large expressions small and evaluates the shared part once.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """`round_even` of something expensive: evaluated once, then rounded."""
    return let(value, lambda v: round_even(v, digits))


def extract_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def extract(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First match of `group`, NULL when there is none (an empty match also reads as none)."""
    found = F.regexp_extract(col(c), pattern, group)
    return let(found, lambda m: F.when(m != "", m))


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(SPACES))


def strip_chars(c: Column, chars: str) -> Column:
    """Trim any of `chars` (already written for a character class) from both ends."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def raw_lines(c: Column | str) -> Column:
    x = col(c)
    return F.when(x.rlike(RARE_BREAK), F.split(x, LINE_BREAK)).otherwise(F.split(x, "\n"))


def clean_lines(c: Column | str) -> Column:
    """Trimmed, non-blank lines in order."""
    return F.filter(F.transform(raw_lines(c), strip), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(extract_all(c, NOT_S + "+"))


def norm_words(c: Column | str) -> Column:
    """Lower-case word tokens."""
    return extract_all(F.lower(col(c)), WORD)


def _sql(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool) or v is None:
        return "NULL" if v is None else str(v).lower()
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, dict):
        return "map(" + ", ".join(f"{_sql(k)}, {_sql(x)}" for k, x in v.items()) + ")"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql(x) for x in v) + ")"
    return str(v)


def fixed(value) -> Column:
    """A Python list or dictionary as one constant expression."""
    return F.expr(_sql(value))


def lookup(table: dict, key: Column) -> Column:
    """A fixed dictionary as an expression; NULL where the key is unknown."""
    return F.try_element_at(fixed(table), key)


def in_list(c: Column, values: Iterable[str]) -> Column:
    return c.isin(*values)


def quote_words(c: Column | str, n: int) -> Column:
    """K6: the first `n` words, with a mark when more follow."""
    return let(
        extract_all(c, NOT_S + "+"),
        lambda w: F.concat(
            F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit("...")).otherwise("")
        ),
    )


# --- sections ---------------------------------------------------------------------------------


def sections(lines: Column, key_of: Callable[[Column], Column], first: str) -> Column:
    """Cut an array of lines at its headings.

    Returns array<struct<key, start, lines>>; `start` is the 0-based index of the first line of
    the block.  Lines before any heading belong to `first`.  Linear in the number of lines.
    """

    def marks(ls: Column) -> Column:
        head = F.array(F.struct(F.lit(-1).alias("at"), F.lit(first).alias("key")))
        tail = F.array(F.struct(F.size(ls).alias("at"), F.lit("").alias("key")))
        found = F.filter(
            F.transform(ls, lambda x, i: F.struct(i.alias("at"), key_of(x).alias("key"))),
            lambda m: m["key"].isNotNull(),
        )
        return F.concat(head, found, tail)

    def cut(ls: Column, ms: Column) -> Column:
        def block(m: Column, i: Column) -> Column:
            after = F.get(ms, i + 1)["at"]
            return F.struct(
                m["key"].alias("key"),
                (m["at"] + 1).alias("start"),
                F.slice(ls, m["at"] + 2, after - m["at"] - 1).alias("lines"),
            )

        return F.transform(F.slice(ms, 1, F.size(ms) - 1), block)

    return let(lines, lambda ls: let(marks(ls), lambda ms: cut(ls, ms)))


def lines_of(blocks: Column, *keys: str) -> Column:
    """All lines of the named sections, in order."""
    return F.flatten(
        F.transform(F.filter(blocks, lambda b: b["key"].isin(*keys)), lambda b: b["lines"])
    )


def distinct_by(arr: Column, key_of: Callable[[Column], Column]) -> Column:
    """Keep the first element per key, in order."""

    def firsts(a: Column, keys: Column) -> Column:
        # the last entry wins when a map is built with duplicate keys, so go through the
        # distinct keys and look each one up once
        return F.transform(
            F.array_distinct(keys), lambda k: F.get(a, (F.array_position(keys, k) - 1).cast("int"))
        )

    return let(arr, lambda a: let(F.transform(a, lambda x: key_of(x)), lambda ks: firsts(a, ks)))


# --- invisible text ---------------------------------------------------------------------------


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it.  NULL in, NULL out."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalise(c: Column | str) -> Column:
    """Drop invisible characters, fold compatibility forms, collapse white space.

    Only text with a non-ASCII character is sent through Arrow; plain ASCII has no invisible
    character and is its own NFKC.
    """
    x = col(c)
    folded = nfkc(F.when(~is_ascii(x), F.regexp_replace(x, L.INVISIBLES, "")))
    return strip(F.regexp_replace(F.coalesce(folded, x), S + "+", " "))


def injection_match(
    normalised: Column,
    patterns: Iterable[str] = L.INJECTION_PATTERNS,
    hints: Iterable[str] | None = None,
) -> Column:
    """the first instruction-like phrase in already normalised text, or NULL.

    `hints` are words at least one of which stands in every possible match.  Looking for them
    is a plain byte search, so the long alternation only ever runs on the few texts that hold
    one.  The built-in patterns have theirs; own patterns come with their own hints, or with none.
    """
    x = normalised
    if hints is None:
        hints = L.INJECTION_HINTS if patterns is L.INJECTION_PATTERNS else ()
    match = by_script(x, lambda u: extract(x, rx(any_of(patterns), unicode=u)))
    if not hints:
        return match
    low = F.lower(x)
    return F.when(reduce(or_, [low.contains(h) for h in hints]), match)


def invisible_payload(c: Column | str, zero_width_min: int = 3) -> Column:
    """text smuggled in characters a reader cannot see; '' when there is none."""

    def decoded(tags: Column) -> Column:
        codes = F.transform(tags, lambda t: F.ascii(t) - F.lit(0xE0000))
        shown = F.filter(codes, lambda n: n.between(0x20, 0x7E))
        return strip(F.array_join(F.transform(shown, lambda n: F.chr(n)), ""))

    def tag_part(tags: Column) -> Column:
        count = F.concat(
            F.lit("["), F.size(tags).cast("string"), F.lit(" invisible tag characters]")
        )
        return F.when(F.size(tags) > 0, F.coalesce(F.nullif(decoded(tags), F.lit("")), count))

    def zero_part(n: Column) -> Column:
        note = F.concat(
            F.lit("["), n.cast("string"), F.lit(" zero-width characters embedded in the text]")
        )
        return F.when(n >= zero_width_min, note)

    # most text has none of these characters: one scan decides, the rest is skipped
    suspect = col(c).rlike(f"{L.TAG_CHARS}|{L.ZERO_WIDTH}")
    return F.when(
        suspect,
        let(
            F.regexp_replace(col(c), L.FLAG_EMOJI, ""),
            lambda t: F.concat_ws(
                " ",
                let(extract_all(t, L.TAG_CHARS), tag_part),
                let(count_of(t, L.ZERO_WIDTH), zero_part),
            ),
        ),
    ).otherwise(F.lit(""))


# --- claims text ------------------------------------------------------------------------------


def specificity(c: Column | str) -> Column:
    """Figures and proper names raise it, vague verbs lower it, clipped to 0..1."""
    x = col(c)
    concrete = count_of(x, rx(L.METRIC)) + count_of(x, rx(L.PROPER_WORD, fold=False))

    def score(words: Column) -> Column:
        vague = F.size(F.filter(words, lambda w: w.isin(*L.VAGUE_VERBS)))
        raw = F.lit(0.3) + concrete * 0.15 - vague * 0.2
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(
            rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)
        )

    return let(extract_all(F.lower(x), "[a-z]+"), score)


def json_block(c: Column | str) -> Column:
    """The JSON object inside fenced or chatty text, as text; NULL when there is none."""
    x = col(c)
    fenced = extract(x, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return extract(F.coalesce(fenced, x), r"(?s)\{.*\}")
