"""Web pages reduced to text, headings, links and the technologies they mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import lexicons as L
from attestry.conf import DEFAULT, Config
from attestry.functions.limits import first_chars, first_items
from attestry.functions.skills import GRAPH, SkillGraph, canonical
from attestry.functions.text import S, col, extract_all, norm_words, rx
from attestry.functions.urls import absolute, demo_links


def html_text(c: Column | str) -> Column:
    """Visible text of a page: scripts, styles and tags out, white space collapsed."""
    body = F.regexp_replace(col(c), "(?si)" + L.SCRIPT_OR_STYLE, " ")
    text = F.regexp_replace(body, L.HTML_TAG, " ")
    text = F.regexp_replace(F.regexp_replace(text, "&amp;", "&"), "&nbsp;", " ")
    return F.trim(F.regexp_replace(text, S + "+", " "))


def headings(c: Column | str, conf: Config = DEFAULT) -> Column:
    found = first_items(extract_all(c, "(?si)" + L.HTML_HEADING, 1), conf.max_headings)
    return F.transform(found, lambda h: first_chars(html_text(h), conf.heading_chars))


def links(c: Column | str, conf: Config = DEFAULT) -> Column:
    """Distinct link targets in byte order."""
    found = F.array_sort(F.array_distinct(extract_all(c, rx(L.HTML_HREF), 1)))
    return first_items(found, conf.max_links)


def read_pages(
    pages: DataFrame, conf: Config = DEFAULT, graph: SkillGraph = GRAPH, *, html: str = "html"
) -> DataFrame:
    """pages(…, url, html) → the same keys with text, headings, links, tech, outbound, demos."""
    keep = [c for c in pages.columns if c != html]
    staged = pages.select(
        *keep,
        html_text(html).alias("full_text"),
        headings(html, conf).alias("headings"),
        links(html, conf).alias("links"),
    )
    words = F.array_distinct(norm_words("full_text"))
    tech = F.array_sort(
        F.array_distinct(
            F.filter(F.transform(words, lambda w: canonical(w, graph)), lambda s: s.isNotNull())
        )
    )
    outbound = F.transform(
        F.filter(
            F.col("links"),
            lambda x: (x != "") & ~x.startswith("#") & ~F.lower(x).startswith("mailto:"),
        ),
        lambda x: absolute(F.col("url"), x),
    )
    return staged.select(
        *keep,
        first_chars("full_text", conf.page_chars).alias("text"),
        "headings",
        "links",
        tech.alias("tech"),
        outbound.alias("outbound"),
    ).withColumn("demo_links", demo_links(F.col("outbound"), conf.max_demo_links))
