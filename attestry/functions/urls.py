"""Which pages may be read, decided without any network access."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import lexicons as L
from attestry.functions.limits import first_items
from attestry.functions.text import col, let, raw_lines, strip


def robots_allowed(robots: Column, path: Column) -> Column:
    """Longest matching rule of the `*` agent wins, ties allow, no matching rule allows.

    Every User-agent line replaces the one before it; a rule belongs to the last agent named.
    Rules are paired with their agent by position, so one pass over the file is enough.
    """
    rows = F.transform(
        raw_lines(F.coalesce(robots, F.lit(""))),
        lambda x: strip(F.regexp_extract(x, "^[^#]*", 0)),
    )
    parsed = F.transform(
        F.filter(rows, lambda x: x.contains(":")),
        lambda x: F.struct(
            F.lower(strip(F.substring_index(x, ":", 1))).alias("key"),
            strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("val"),
        ),
    )
    zero = F.struct(F.lit(False).alias("on"), F.lit(0).alias("allow"), F.lit(0).alias("deny"))

    def step(acc: Column, r: Column) -> Column:
        hit = acc["on"] & (r["val"] != "") & F.startswith(path, r["val"])
        size = F.length(r["val"])
        return F.struct(
            F.when(r["key"] == "user-agent", r["val"] == "*").otherwise(acc["on"]).alias("on"),
            F.when(hit & (r["key"] == "allow"), F.greatest(acc["allow"], size))
            .otherwise(acc["allow"])
            .alias("allow"),
            F.when(hit & (r["key"] == "disallow"), F.greatest(acc["deny"], size))
            .otherwise(acc["deny"])
            .alias("deny"),
        )

    return F.aggregate(
        parsed, zero, step, lambda a: (a["deny"] == 0) | (a["allow"] >= a["deny"])
    )


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column | str) -> Column:
    """Lower-case host without user, port, brackets or trailing dots; '' when there is none."""
    authority = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, "^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    name = F.when(v6 != "", v6).otherwise(F.regexp_replace(bare, r":\d*$", ""))
    return F.lower(F.regexp_replace(name, r"\.+$", ""))


def path(url: Column | str) -> Column:
    p = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def ipv4_value(h: Column) -> Column:
    """The address a resolver would read out of 1-4 decimal, octal or hex parts; else NULL."""
    number = r"(?:0[xX][0-9a-fA-F]+|\d+)"

    def part(p: Column) -> Column:
        digits = (
            F.when(p.rlike(r"^0[xX]"), F.conv(F.substring(p, 3, 20), 16, 10))
            .when(p.rlike(r"^0[0-7]+$"), F.conv(p, 8, 10))
            .when(p.rlike(r"^(?:0|[1-9]\d*)$"), p)
        )
        return digits.try_cast("long")

    def combine(parts: Column) -> Column:
        n = F.size(parts)
        lead = F.slice(parts, 1, n - 1)
        last = F.element_at(parts, -1)
        valid = F.forall(lead, lambda v: F.coalesce(v.between(0, 255), F.lit(False)))
        # leading parts fill the address from the left, the last part fills what is left
        base = F.aggregate(lead, F.lit(0).cast("long"), lambda a, v: a * 256 + v)
        room = F.pow(F.lit(256.0), 5 - n).cast("long")
        return F.when(valid & (last >= 0) & (last < room), base * room + last)

    shaped = h.rlike(rf"^{number}(?:\.{number}){{0,3}}$")
    return F.when(shaped, let(F.transform(F.split(h, r"\."), part), combine))


def non_public_v4(value: Column) -> Column:
    blocks = F.array(
        *[
            F.struct(
                F.lit(int(ipaddress.IPv4Address(lo))).alias("lo"),
                F.lit(int(ipaddress.IPv4Address(hi))).alias("hi"),
            )
            for lo, hi in L.NON_PUBLIC_V4
        ]
    )
    return F.exists(blocks, lambda b: value.between(b["lo"], b["hi"]))


def url_problem(url: Column | str) -> Column:
    """why an address must not be read, NULL when it may be."""
    local_v6 = r"^(?:::1?$|f[cd]|fe[89ab]|ff|2001:db8:|100::|64:ff9b:1:|2001:0?:)"
    mapped_v6 = r"^::ffff:(\d+\.\d+\.\d+\.\d+)$"
    banned = "^(?:.*\\.)?(?:" + "|".join(h.replace(".", "\\.") for h in L.BANNED_HOSTS) + ")$"
    local = "(?:^localhost|" + "|".join(s.replace(".", "\\.") for s in L.LOCAL_SUFFIXES) + ")$"

    def address(h: Column) -> Column:
        v4 = F.when(h.rlike(mapped_v6), F.regexp_extract(h, mapped_v6, 1)).otherwise(h)
        return let(
            ipv4_value(v4),
            lambda v: F.when(v.isNotNull(), non_public_v4(v)).otherwise(h.rlike(local_v6)),
        )

    def check(h: Column) -> Column:
        return (
            F.when(~scheme(url).isin("http", "https"), "scheme")
            .when(h == "", "no_host")
            .when(h.rlike(banned), "banned_host")
            .when(h.rlike(local), "local_name")
            .when(address(h), "not_public")
        )

    return let(host(url), check)


def absolute(base: Column, link: Column) -> Column:
    """A link as the page's reader would follow it."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(
            F.length(folder) <= F.length(origin),
            F.concat(origin, F.lit("/"), link),
        )
        .otherwise(F.concat(folder, link))
    )


def demo_links(links: Column, limit: int | None = None) -> Column:
    marked = F.filter(links, lambda x: F.lower(x).rlike(_demo_pattern()))
    return first_items(marked, limit)


def _demo_pattern() -> str:
    return "|".join(m.replace(".", r"\.") for m in L.DEMO_MARKS)
