"""Text fragments shared by the oracle SQL."""

from __future__ import annotations

from attestry.functions.skills import GRAPH

# Unicode white space, spelled out because the oracle's \s is ASCII only.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, columns: str, name: str) -> str:
    def lit(v):
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return "NULL" if v is None else str(v) if isinstance(v, int) else quoted(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {name}_v({columns})) {name}"


def listed(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lines(expr: str) -> str:
    """Trimmed, non-blank lines as a list."""
    return (
        f"list_filter(list_transform(string_split_regex({expr}, '{LINE_BREAK}'), "
        f"lambda x: {strip('x')}), lambda x: x <> '')"
    )


def norm_words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[a-z0-9+#.]+')"


def exact_round(expr: str, digits: int) -> str:
    """Half-to-even on the exact binary value; the error of the scaling product is recovered."""
    scale = 10.0**digits
    t = 134217729.0 * scale
    ch = t - (t - scale)
    cl = scale - ch
    x, d = "x", "::DOUBLE"
    xh = f"(x * 134217729.0{d} - (x * 134217729.0{d} - x))"
    xl = f"(x - {xh})"
    p = f"(x * {scale!r}{d})"
    err = f"({xl} * {cl!r}{d} - ((({p} - {xh} * {ch!r}{d}) - {xl} * {ch!r}{d}) - {xh} * {cl!r}{d}))"
    rest = f"({p} - floor({p}))"
    tie = f"CASE WHEN {err} > 0 THEN 1.0{d} WHEN {err} < 0 THEN 0.0{d} ELSE abs(floor({p}) % 2) END"
    up = f"CASE WHEN {rest} > 0.5 THEN 1.0{d} WHEN {rest} < 0.5 THEN 0.0{d} ELSE {tie} END"
    return f"list_transform([({expr})::DOUBLE], lambda {x}: (floor({p}) + {up}) / {scale!r}{d})[1]"


ALIASES = values(GRAPH.aliases(), "alias, ord, skill", "al")
