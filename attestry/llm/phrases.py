"""Collocations: phrases whose words stand together more often than their parts suggest.

Phrases are mined by partitioning (SON).  Documents fall into a few shards; a phrase that occurs
`support` times in all occurs support / shards times or more in one of them, so mining every
shard completely at that lowered support finds a superset of the frequent phrases.  The union of
what is frequent in some shard is then counted exactly over all documents.

* The first pass counts 64-bit hashes of (language, phrase) for each shard.  A shard is no task:
  its counts are spread by the hash, so neither a large shard nor a common phrase is gathered.
  Colliding hashes only add candidates.
* The second pass reads the texts again and spells out the phrases that pass a filter of the
  candidates (`membership`); counts are summed by the spelling, so the result is exact.  Within
  a slice of a text batch equal 64-bit hashes count as equal phrases.

All arrays belong to a slice of a batch.  A very long text is cut where a piece ends, which no
phrase crosses.

Defined results: null and empty texts have no words; a null language is `und`, together with
rows that say so; repeated rows count as often as they stand; ties rank by the phrase's bytes;
an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches
from attestry.llm.hashing import byte_table, mix, row_slices, run_hashes, seeded, signed, text_buffer, word_bounds
from attestry.llm.membership import membership
from attestry.session import cut_lineage

SUPPORT = 10
MINING_SHARDS = 4
LONGEST = 3
SLICE = 1 << 20
COVERED_PERCENT = 50
TOP = 2000
UNKNOWN_LANG = "und"

# [.,;:!?\x0A-\x0D] end a piece; [^\x20\x09] are words
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets); one long row comes as several, cut at piece ends."""
    raw, off = text_buffer(texts)
    for lo, hi in row_slices(np.diff(off), SLICE):
        part, bounds = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if hi - lo > 1 or len(part) <= 2 * SLICE:
            yield lo, hi, part, bounds
            continue
        breaks = np.flatnonzero(BREAK[part])
        wanted = np.searchsorted(breaks, np.arange(SLICE, len(part), SLICE))
        cuts = np.unique(np.concatenate(([0], breaks[wanted[wanted < len(breaks)]], [len(part)])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield lo, hi, part[a:b], np.array([0, b - a])


class Words:
    """The words of one chunk, and its phrases by length."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lang: np.ndarray, longest: int):
        self.raw = raw
        self.starts, self.ends, first = word_bounds(raw, off, WORD)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        self.hashes = run_hashes(byte_table(True)[raw], self.starts, self.ends)
        ends_before = np.concatenate(([0], np.cumsum(BREAK[raw])))
        apart = ends_before[self.starts[1:]] != ends_before[self.ends[:-1]]
        self.joined = ~apart & (self.row[1:] == self.row[:-1])
        self._seeds, self._factors, self.longest = lang[self.row], seeded(longest, 23), longest

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, first words, signed hashes of language and phrase)."""
        n = len(self.starts)
        at, sums = np.arange(n), self._seeds.copy()
        for k in range(self.longest):
            if k:
                at = at[at < n - k]
                at = at[self.joined[at + k - 1]]
            sums[at] += self.hashes[at + k] * self._factors[k]
            yield k + 1, at, signed(mix(sums[at] + np.uint64(k)))

    def spelled(self, first: np.ndarray, n: int) -> pa.Array:
        """The lower-cased words first .. first + n - 1, joined by a space."""
        places = [first + k for k in range(n)]
        known, where = np.unique(self.hashes[np.concatenate(places)], return_index=True)
        where = np.concatenate(places)[where]
        sizes = self.ends[where] - self.starts[where]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        chars = LOWER[self.raw[np.repeat(self.starts[where] - bounds[:-1], sizes) + np.arange(bounds[-1])]]
        words = pa.StringArray.from_buffers(len(where), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(chars))
        parts = [words.take(pa.array(np.searchsorted(known, self.hashes[p]))) for p in places]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def _lang_hashes(langs: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each row the hash and the number of its language, and the languages."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    digests = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return np.array(digests, np.uint64)[codes], codes, names


def _shard_counts(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds, _, _ = _lang_hashes(batch["lang"])
            shard = batch["shard"].to_numpy()
            for lo, hi, raw, off in _chunks(batch["text"]):
                words = Words(raw, off, seeds[lo:hi], longest)
                mine = shard[lo:hi][words.row]
                found = [(at, h) for _, at, h in words.phrases()]
                at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                for s in np.unique(mine):
                    keys, counts = np.unique(hashes[mine[at] == s], return_counts=True)
                    yield pa.record_batch(
                        [pa.array(keys), pa.array(np.full(len(keys), s, np.int32)), pa.array(counts.astype(np.int64))],
                        ["key", "shard", "n"],
                    )

    return count


def _exact_counts(longest: int, candidates):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds, codes, names = _lang_hashes(batch["lang"])
            names = pa.array(names, pa.string())
            for lo, hi, raw, off in _chunks(batch["text"]):
                words = Words(raw, off, seeds[lo:hi], longest)
                lang = codes[lo:hi][words.row]
                here, counts = np.unique(lang, return_counts=True)
                yield _rows(names, here, pa.array([""] * len(here), pa.string()), 0, counts)
                for n, at, hashes in words.phrases():
                    held = candidates.may_hold(hashes)
                    at = at[held]
                    if len(at):
                        _, first, counts = np.unique(hashes[held], return_index=True, return_counts=True)
                        yield _rows(names, lang[at[first]], words.spelled(at[first], n), n, counts)

    return count


def _rows(names: pa.Array, lang: np.ndarray, phrase: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [names.take(pa.array(lang)), phrase, pa.array(np.full(len(lang), n, np.int32)), pa.array(counts.astype(np.int64))],
        ["lang", "phrase", "words", "n"],
    )


def frequent_phrases(
    docs: DataFrame,
    support: int = SUPPORT,
    longest: int = LONGEST,
    shards: int = MINING_SHARDS,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, phrase, words, count) of every phrase of up to `longest` words with `support`.

    Rows with words = 0 hold the number of all words of a language.  Counts are exact.
    """
    bounded_batches(docs.sparkSession)
    said = F.coalesce(docs[text], F.lit(""))
    spoken = F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN_LANG))
    shard = F.pmod(F.xxhash64(said), F.lit(shards)).cast("int")
    texts = docs.select(spoken.alias("lang"), said.alias("text"))

    local = docs.select(spoken.alias("lang"), said.alias("text"), shard.alias("shard"))
    local = local.mapInArrow(_shard_counts(longest), "key bigint, shard int, n bigint")
    # one row for each hash and task crosses the shuffle, with its counts by shard
    sums = [F.sum(F.when(F.col("shard") == s, F.col("n"))).alias(f"in_{s}") for s in range(shards)]
    least = -(-support // shards)
    frequent = " OR ".join(f"in_{s} >= {least}" for s in range(shards))
    candidates = cut_lineage(local.groupBy("key").agg(*sums).where(frequent).select("key"))

    known = membership(candidates)
    counted = texts.mapInArrow(_exact_counts(longest, known), "lang string, phrase string, words int, n bigint")
    counts = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("count"))
    return cut_lineage(counts.where((F.col("words") == 0) | (F.col("count") >= support)))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly, for counts up to 10**16."""
    wide = "decimal(19,0)"
    a, left, right = a.cast(wide), left.cast(wide), right.cast(wide)
    return F.call_function("div", a * a * F.lit(1000000).cast("decimal(7,0)"), left * right)


def collocations(
    phrases: DataFrame, longest: int = LONGEST, covered_percent: int = COVERED_PERCENT, top: int | None = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Of all cuts of a phrase in two the lowest score counts.  Every part of a frequent phrase is
    frequent, so all counts stand in `phrases`.  Phrases of which a longer one covers
    `covered_percent` or more go.  `top` is the report's length, None for all.
    """
    counts = phrases.where("words > 0").select("lang", "phrase", "words", "count")
    split = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))

    cut = split.select("lang", "phrase", F.col("count").alias("a"), "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), " ").alias("rest"),
    )
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    best = F.min(F.struct(score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(best.alias("best"))

    inner = split.where("words > 2").select(
        "lang", F.col("count").alias("longer"), "parts", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n")
    )
    inner = inner.select("lang", "longer", "parts", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    inner = inner.select("lang", "longer", F.array_join(F.slice("parts", F.col("at"), F.col("n")), " ").alias("phrase"))
    cover = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(cover, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select("lang", F.col("count").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )
