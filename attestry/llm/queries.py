"""The registered queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.alignment import align_tokens
from attestry.llm.covertree import near_vectors
from attestry.llm.langid import identify
from attestry.llm.leaks import PARTS, item_parts, leaked_items
from attestry.llm.lines import dedup_lines
from attestry.llm.mixing import mix_to_targets
from attestry.llm.near_dedup import near_duplicates
from attestry.llm.pages import main_text
from attestry.llm.phrases import collocations, frequent_phrases
from attestry.llm.preferences import pair_by_opening, preference_examples, turns_of
from attestry.llm.secret_scan import KINDS, joined, secrets_in
from attestry.llm.sharding import interleave, measured
from attestry.llm.suffixes import remove_repeats

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secrets_in(F.col("text")).alias("found"))
    spans = F.col("found.spans")
    base = F.filter(spans, lambda s: s["depth"] == 0)

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.col("found.n_layers").cast("bigint").alias("n_layers"),
        F.col("found.n_refused").cast("bigint").alias("n_refused"),
    )


@register
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op7_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select(
        "doc_id",
        "lines.n_lines",
        "lines.n_removed",
        "lines.n_near",
        F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"),
    )


@register
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("cut.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return cut.select(
        "doc_id",
        "cut.n_bytes",
        removed.alias("n_removed"),
        F.size("cut.spans").cast("bigint").alias("n_spans"),
        F.sha2("cut.kept", 256).alias("kept_sha256"),
    )


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


@register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    question, answer = item_parts(F.col("text"))
    hits = leaked_items(docs, table(spark, sf_dir, "benchmark"), question=question, answer=answer)
    found = docs.select("doc_id", F.explode(hits).alias("hit"))
    return found.select("doc_id", F.col("hit.item").alias("item_id")).distinct()


_WORDS = "regexp_extract_all(lower({}), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"

LLM_ORACLES["op2_benchmark_decontamination"] = f"""
WITH parts AS (
  SELECT item_id, CASE WHEN answer = '' THEN text ELSE question END AS question, answer
  FROM (SELECT DISTINCT item_id, text, regexp_extract(text, '{PARTS}', 1) AS question,
               regexp_extract(text, '{PARTS}', 2) AS answer FROM benchmark WHERE item_id IS NOT NULL)),
words AS (
  SELECT item_id, part, w FROM (
    SELECT item_id, 0 AS part, {_WORDS.format("question")} AS w FROM parts UNION ALL
    SELECT item_id, 1 AS part, {_WORDS.format("answer")} AS w FROM parts) WHERE len(w) > 0),
longest AS (SELECT greatest(128, 2 * max(n)) AS size FROM (SELECT sum(len(w)) AS n FROM words GROUP BY item_id)),
wanted AS (
  SELECT DISTINCT item_id, part, least(5, len(w)) AS n, w[i:i + least(5, len(w)) - 1] AS gram
  FROM words, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS r(i)),
whole AS (SELECT item_id, count(*) AS total FROM wanted GROUP BY item_id),
texts AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM wanted),
starts AS (
  SELECT doc_id, len(w) AS total_words, i - 1 AS pos, n, w[i:i + n - 1] AS gram
  FROM texts, lengths, unnest(range(1, len(w) - n + 2)) AS r(i)),
met AS (
  SELECT doc_id, item_id, part, s.gram, pos, n, size, size // 2 AS stride,
         greatest(0, ceil((total_words - size) / (size // 2)))::BIGINT AS last_passage
  FROM starts s JOIN wanted USING (n, gram), longest),
placed AS (
  SELECT DISTINCT doc_id, item_id, k, part, gram FROM (
    SELECT *, least(pos // stride, last_passage) AS k FROM met UNION ALL
    SELECT *, least(pos // stride, last_passage) - 1 AS k FROM met)
  WHERE k >= 0 AND pos >= k * stride AND pos + n <= k * stride + size)
SELECT DISTINCT doc_id, item_id FROM (
  SELECT doc_id, item_id, k, count(*) AS shared FROM placed GROUP BY ALL) JOIN whole USING (item_id)
WHERE shared >= 0.75 * total
"""


@register
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(table(spark, sf_dir, "pages"))
    return pages.select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("bigint").alias("n_chars"),
    )


@register
def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return preference_examples(turns, pair_by_opening(turns))


LLM_ORACLES["op4_preference_formatting"] = """
WITH turns AS (
  SELECT conv_id, turn, said.role AS role, said.text AS text FROM (
    SELECT conv_id, coalesce(turn, -1) AS turn,
           min({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}) AS said
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL)),
opening AS (
  SELECT conv_id, first.role AS role, first.text AS text FROM (
    SELECT conv_id, min({'turn': turn, 'role': role, 'text': text}) AS first FROM turns GROUP BY conv_id)),
pairs AS (
  SELECT chosen, rejected FROM (
    SELECT conv_id AS chosen, lead(conv_id) OVER w AS rejected, row_number() OVER w AS place FROM opening
    WINDOW w AS (PARTITION BY role, text, conv_id // 1024 ORDER BY conv_id)) WHERE place % 2 = 1),
a AS (SELECT chosen, rejected, turn, role, text FROM pairs JOIN turns ON conv_id = chosen),
b AS (SELECT chosen, rejected, turn, role, text FROM pairs JOIN turns ON conv_id = rejected),
split AS (
  SELECT coalesce(a.chosen, b.chosen) AS chosen, min(coalesce(a.turn, b.turn)) AS split
  FROM a FULL JOIN b ON a.chosen = b.chosen AND a.turn = b.turn
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
parts AS (
  SELECT a.*, CASE WHEN rejected IS NULL THEN 'unpaired' WHEN split IS NULL OR turn < split THEN 'prompt'
                   ELSE 'chosen' END AS part FROM a LEFT JOIN split USING (chosen)
  UNION ALL
  SELECT b.*, 'rejected' AS part FROM b JOIN split USING (chosen) WHERE turn >= split),
rendered AS (
  SELECT *, length(role) + 13 AS head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM parts),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY chosen, part ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM rendered)
SELECT chosen, rejected, part, turn, role, rendered, begin_at AS begin,
       CASE WHEN part IN ('chosen', 'rejected') AND role = 'assistant' THEN begin_at + head END AS loss_begin,
       CASE WHEN part IN ('chosen', 'rejected') AND role = 'assistant' THEN begin_at + length(rendered) END AS loss_end
FROM placed
"""


@register
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_to_targets(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "mixing.source",
        "mixing.lang",
        "mixing.topic",
        "mixing.n_tokens",
        F.round("mixing.weight", 8).alias("weight"),
        F.round("mixing.prob", 8).alias("prob"),
        "mixing.sampled",
    )


# Raking and the scale of the probabilities as recursions; both have converged long before
# their last step.
MIXED_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(source, '(none)') AS m_source, coalesce(lang, '(none)') AS m_lang,
         CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, '###') OR contains(text, '%%%') THEN 'symbols'
              WHEN contains(text, chr(10)) THEN 'prose' ELSE 'line' END AS m_topic,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM {docs}),
cells AS (
  SELECT m_source, m_lang, m_topic, sum(n_tokens)::DOUBLE AS tokens FROM keyed GROUP BY ALL HAVING sum(n_tokens) > 0),
goal_source AS (SELECT m_source, sum(tokens) ** 0.5 / sum(sum(tokens) ** 0.5) OVER () AS gs FROM cells GROUP BY 1),
goal_lang AS (SELECT m_lang, sum(tokens) ** 0.7 / sum(sum(tokens) ** 0.7) OVER () AS gl FROM cells GROUP BY 1),
goal_topic AS (SELECT m_topic, sum(tokens) ** 0.8 / sum(sum(tokens) ** 0.8) OVER () AS gt FROM cells GROUP BY 1),
rake AS (
  SELECT 0 AS step, m_source, m_lang, m_topic, tokens, gs, gl, gt, tokens AS weight
  FROM cells JOIN goal_source USING (m_source) JOIN goal_lang USING (m_lang) JOIN goal_topic USING (m_topic)
  UNION ALL
  SELECT step + 1, m_source, m_lang, m_topic, tokens, gs, gl, gt, w2 * gt / sum(w2) OVER (PARTITION BY m_topic) FROM (
    SELECT *, w1 * gl / sum(w1) OVER (PARTITION BY m_lang) AS w2 FROM (
      SELECT *, weight * gs / sum(weight) OVER (PARTITION BY m_source) AS w1 FROM rake WHERE step < 120))),
raked AS (SELECT * FROM rake WHERE step = 120),
scales AS (
  SELECT 0 AS step, 0.5 * sum(tokens) AS goal, 0.5 * sum(tokens) AS scale FROM raked
  UNION ALL
  SELECT step + 1, goal, greatest(scale, (goal - held) / free) FROM (
    SELECT s.step, s.goal, s.scale,
           sum(CASE WHEN s.scale * weight >= tokens THEN tokens ELSE 0 END) AS held,
           sum(CASE WHEN s.scale * weight >= tokens THEN 0 ELSE weight END) AS free
    FROM scales s, raked WHERE s.step < 60 GROUP BY ALL)),
final AS (
  SELECT m_source, m_lang, m_topic, weight, least(1.0, scale * weight / tokens) AS prob
  FROM raked, (SELECT max(scale) AS scale FROM scales)),
mixed AS (
  SELECT keyed.*, CASE WHEN n_tokens > 0 THEN weight / (SELECT sum(weight) FROM final) ELSE 0 END AS weight,
         CASE WHEN n_tokens > 0 THEN prob ELSE 0 END AS prob
  FROM keyed LEFT JOIN final USING (m_source, m_lang, m_topic))
"""

LLM_ORACLES["op6_source_mixing"] = (
    MIXED_SQL.replace("{docs}", "documents")
    + """SELECT doc_id, m_source AS source, m_lang AS lang, m_topic AS topic, n_tokens, round(weight, 8) AS weight,
       round(prob, 8) AS prob, draw < prob AS sampled FROM mixed"""
)


@register
def op13_interleaved_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return placed.select(
        "doc_id",
        "content.size",
        "content.text_crc32",
        F.lit("rows").alias("law"),
        "place.shard",
        "place.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The checksum byte by byte from its table; DuckDB has no function for it.
LLM_ORACLES["op13_interleaved_sharding"] = """
WITH RECURSIVE crc_steps AS (
  SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
keyed AS (
  SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
         ('0x' || substr(md5('shard' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents, crc_table),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) - 1)
            / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM keyed),
merged AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard,
       (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM merged
"""


@register
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))


LLM_ORACLES["op12_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM words, range(1, 4) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i)),
counts AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
parts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM counts, range(1, 3) AS s(k) WHERE size > k),
cuts AS (
  SELECT p.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.first JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
cover AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(string_split(phrase, ' ')[:2], ' ') AS phrase, f FROM counts WHERE size = 3 UNION ALL
    SELECT lang, array_to_string(string_split(phrase, ' ')[2:], ' ') AS phrase, f FROM counts WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN cover c USING (lang, phrase) WHERE c.f IS NULL OR 100 * c.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@register
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
