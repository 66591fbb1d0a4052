"""Profile exports, structured or as text, to one row per role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import lexicons as L
from attestry.functions.text import clean_lines, let, rx

ROLE = "struct<title:string,company:string,start:string,end:string>"
EXPORT = (
    "roles array<struct<title:string,company:string,start:string,end:string>>, "
    "education array<string>, skills array<string>, certifications array<string>, _bad string"
)


def read_structured(exports: DataFrame, *, key: str = "candidate_id", raw: str = "content") -> DataFrame:
    """JSON exports → (key, status, roles, education, skills, certifications).

    A document that does not parse keeps its row with status 'error'; no export is 'missing'.
    """
    parsed = exports.withColumn(
        "_p",
        F.from_json(
            raw, EXPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        ),
    )
    status = (
        F.when(F.col(raw).isNull() | (F.trim(raw) == ""), "missing")
        .when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "error")
        .otherwise("ok")
    )
    blank = lambda f, r: F.coalesce(r[f], F.lit("")).alias(f)
    roles = F.transform(
        F.coalesce(F.col("_p.roles"), F.array().cast(f"array<{ROLE}>")),
        lambda r: F.struct(*[blank(f, r) for f in ("title", "company", "start", "end")]),
    )
    return parsed.withColumn("status", status).select(
        key,
        "status",
        F.when(F.col("status") == "ok", roles)
        .otherwise(F.array().cast(f"array<{ROLE}>"))
        .alias("roles"),
        F.col("_p.education").alias("education"),
        F.col("_p.skills").alias("skills"),
        F.col("_p.certifications").alias("certifications"),
    )


def roles_of_text(text: Column) -> Column:
    """A dated line is a role; the line before it is the title, the one before the company.

    Where the export has an Experience heading only that section counts.
    """

    def read(ls: Column) -> Column:
        marked = F.transform(
            ls,
            lambda x, i: F.struct(
                i.alias("i"),
                F.when(x.rlike(rx(L.EXPORT_SECTION)), F.lower(x)).alias("section"),
                F.regexp_extract(x, rx(L.EXPORT_DATES), 1).alias("start"),
                F.regexp_extract(x, rx(L.EXPORT_DATES), 2).alias("end"),
            ),
        )
        return let(marked, lambda ms: pick(ls, ms))

    def pick(ls: Column, ms: Column) -> Column:
        heads = F.filter(ms, lambda m: m["section"].isNotNull())
        return let(heads, lambda hs: collect(ls, ms, hs))

    def collect(ls: Column, ms: Column, hs: Column) -> Column:
        sectioned = F.exists(hs, lambda h: h["section"] == "experience")

        def inside(m: Column) -> Column:
            last = F.try_element_at(F.filter(hs, lambda h: h["i"] < m["i"]), F.lit(-1))
            return ~sectioned | F.coalesce(last["section"] == "experience", F.lit(False))

        def before(m: Column, n: int) -> Column:
            return F.coalesce(F.get(ls, m["i"] - n), F.lit(""))

        dated = F.filter(
            ms, lambda m: m["section"].isNull() & (m["start"] != "") & inside(m)
        )
        return F.transform(
            dated,
            lambda m: F.struct(
                before(m, 1).alias("title"),
                before(m, 2).alias("company"),
                m["start"].alias("start"),
                F.initcap(m["end"]).alias("end"),
            ),
        )

    return let(clean_lines(text), read)


def parse_text_export(
    exports: DataFrame, *, key: str = "candidate_id", raw: str = "content"
) -> DataFrame:
    staged = exports.select(key, raw, roles_of_text(F.coalesce(raw, F.lit(""))).alias("roles"))
    status = F.when(F.size("roles") > 0, "ok").otherwise("error")
    return staged.select(key, status.alias("status"), "roles")


def role_rows(exports: DataFrame, *, key: str = "candidate_id") -> DataFrame:
    """One row per role, numbered from 0; exports without roles keep one empty row."""
    return exports.select(
        key, "status", F.posexplode_outer("roles").alias("role_no", "r")
    ).select(key, "status", "role_no", "r.*")
