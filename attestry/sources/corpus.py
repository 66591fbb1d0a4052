"""Documents in, spans out, refusals kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.conf import DEFAULT, Config
from attestry.functions.limits import too_many
from attestry.functions.text import raw_lines, strip

SPAN = (
    "struct<text:string,size:double,color:int,x0:double,y0:double,x1:double,y1:double,"
    "render_mode:int,bg:int,origin:string>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and markdown files as (doc_id, file_name, n_bytes, text)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64("_metadata.file_path").alias("doc_id"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("n_bytes"),
        F.col("value").alias("text"),
    )


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use every core on a table whose rows lie in a few parts only.

    A file is cut into splits by its size, but a row group is read whole by one of them, so a file
    of one row group has many splits of which all but one are empty.  What counts is therefore the
    rows each part really has: a count that reads no column.  A table whose fullest part holds
    less than twice its share is returned as it is, without a shuffle.  `rows` bounds a task's
    share for tables of short rows, which are cheap to shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    found = parts.agg(F.sum("n").alias("all"), F.max("n").alias("fullest")).first()
    if not found["all"]:
        return df
    tasks = max(cores, -(-found["all"] // rows) if rows else 0)
    return df.repartition(tasks) if found["fullest"] * tasks > 2 * found["all"] else df


def with_intake(docs: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """Mark every document accepted (reason NULL) or refused with a reason and a remedy.

    `docs` needs text, and may carry file_name and n_bytes.  Nothing is dropped: callers split
    on `reason`, so a bad file becomes a row and never a failed job.
    """
    size = F.col("n_bytes") if "n_bytes" in docs.columns else F.octet_length("text")
    name = F.col("file_name") if "file_name" in docs.columns else F.lit(conf.file_types[0])
    known = F.lit(False)
    for ending in conf.file_types:
        known = known | F.lower(name).endswith(ending)
    remedies = F.create_map(
        *[
            F.lit(x)
            for x in (
                "too_large", "compress or split the file, or paste the text",
                "unsupported", "supply plain text or markdown",
                "no_text", "paste the text",
            )
        ]
    )
    reason = (
        F.when(too_many(size, conf.max_bytes), "too_large")
        .when(~known, "unsupported")
        .when(F.coalesce(strip("text"), F.lit("")) == "", "no_text")
    )
    return docs.withColumn("reason", reason).withColumn(
        "remedy", F.try_element_at(remedies, F.col("reason"))
    )


def text_spans(c: Column | str) -> Column:
    """One plain span per non-blank line, as array<struct>."""
    lines = F.filter(raw_lines(c), lambda x: strip(x) != "")
    zero = F.lit(0.0)
    return F.transform(
        lines,
        lambda x: F.struct(
            x.alias("text"),
            F.lit(11.0).alias("size"),
            F.lit(0).alias("color"),
            zero.alias("x0"),
            zero.alias("y0"),
            zero.alias("x1"),
            zero.alias("y1"),
            F.lit(0).alias("render_mode"),
            F.lit(0xFFFFFF).alias("bg"),
            F.lit("body").alias("origin"),
        ),
    )


def as_layout(docs: DataFrame) -> DataFrame:
    """Plain text as the layout table every integrity operator reads (one row per document)."""
    body = strip("text")
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        body.alias("visible_text"),
        F.create_map(F.lit("text"), body).alias("reader_text"),
        F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        ).alias("metadata"),
        F.lit(1).alias("pages"),
        F.lit(612.0).alias("page_w"),
        F.lit(792.0).alias("page_h"),
        F.lit(0.0).alias("image_cover"),
        text_spans("text").alias("spans"),
    )


def read_spans(layout: DataFrame) -> DataFrame:
    """One row per span, numbered within its document."""
    return layout.select(
        "doc_id", F.posexplode("spans").alias("span_no", "span")
    ).select("doc_id", "span_no", "span.*")


def input_gate(
    inputs: DataFrame,
    conf: Config = DEFAULT,
    *,
    group: str = "screening_id",
    jd_text: str = "jd_text",
    text: str = "text",
) -> DataFrame:
    """Accept an input or refuse it with a code; counts are per screening.

    The count is a plain aggregate joined back, so one very large screening is counted with
    partial sums and never gathered in one place.
    """
    counts = inputs.groupBy(group).agg(F.count(F.lit(1)).alias("n_inputs"))
    code = (
        F.when(too_many(F.length(jd_text), conf.jd_max_chars), "JD_TOO_LARGE")
        .when(too_many(F.col("n_inputs"), conf.max_inputs), "TOO_MANY_INPUTS")
        .when(too_many(F.length(text), conf.pasted_max_chars), "TEXT_TOO_LARGE")
    )
    return inputs.join(counts, group).withColumn("reject_code", code)


def align_inputs(screenings: DataFrame) -> DataFrame:
    """Files paired by position with usernames, addresses and exports.

    `screenings` holds one row per request with the arrays files, usernames, urls, exports and
    one consent struct; missing entries become NULL.
    """
    return screenings.select(
        "screening_id",
        "consent",
        F.posexplode_outer(F.arrays_zip("files", "usernames", "urls", "exports")).alias(
            "pos", "item"
        ),
    ).select(
        "screening_id",
        "pos",
        F.col("item.files").alias("file"),
        F.col("item.usernames").alias("username"),
        F.col("item.urls").alias("url"),
        F.col("item.exports").alias("export"),
        "consent",
    ).where(F.col("file").isNotNull())
