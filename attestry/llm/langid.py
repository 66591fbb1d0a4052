"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches
from attestry.session import cut_lineage

UNKNOWN = "und"
# The model is fitted on at most so many labelled rows of each language, chosen by a hash of
# the text.  It bounds the model's size; counts are of whole texts.
ROWS_PER_LANGUAGE = 400
TASK_GROUPS = 256
LONGEST = 5
LEAST_COUNT = 2
SMOOTHING = 0.05
# more words than this add no further certainty to a score
CERTAIN_WORDS = 40
CACHE = 100_000
# so many different words of texts, or one longer text, are looked up together
WORDS_AT_ONCE = 1 << 15

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """How often each run of letters occurs, lower-cased."""
    words = Counter(LETTERS.findall(text.lower()))
    # numbers that are no digits, such as superscripts, look like letters to the pattern
    for word in [w for w in words if not w.isalpha() and not any(map(str.isalpha, w))]:
        del words[word]
    return words


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks for its ends; single characters without."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _counts(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int], Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                total.setdefault((lang, 0), Counter()).update(words)
                for n in range(1, longest + 1):
                    grams = total.setdefault((lang, n), Counter())
                    for word, count in words.items():
                        for gram in grams_of(word, n):
                            grams[gram] += count
            rows = [(lang, n, unit, count) for (lang, n), c in total.items() for unit, count in c.items()]
            lang, n, unit, count = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(unit, pa.string()), pa.array(count, pa.int64())],
                ["lang", "n", "unit", "count"],
            )

    return run


class Model:
    """Log frequencies of words (level 0) and n-grams (level n) by language."""

    def __init__(self, langs: list[str], levels: dict[int, dict[str, int]], tables: dict[int, np.ndarray]):
        self.langs, self.levels, self.tables = langs, levels, tables

    @staticmethod
    def of(counts: pa.Table, smoothing: float = SMOOTHING) -> Model:
        """From a table (lang, n, unit, count)."""
        langs = sorted(set(pc.unique(counts["lang"]).to_pylist()))
        lang = pc.index_in(counts["lang"], pa.array(langs, pa.string())).to_numpy()
        level, count = counts["n"].to_numpy(), counts["count"].to_numpy()
        levels, tables = {}, {}
        for n in np.unique(level).tolist():
            chosen = np.flatnonzero(level == n)
            units = counts["unit"].take(pa.array(chosen)).combine_chunks().dictionary_encode()
            units = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
            table = np.zeros((len(units.dictionary), len(langs)))
            table[units.indices.to_numpy(), lang[chosen]] = count[chosen]
            total = table.sum(axis=0) + smoothing * max(1, len(table))
            levels[n] = {u: k for k, u in enumerate(units.dictionary.to_pylist())}
            tables[n] = np.log((table + smoothing) / total).astype(np.float32)
        return Model(langs, levels, tables)

    def unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the mean log frequency of the longest n-grams of which any is known,
        and whether there are any."""
        levels = sorted((n for n in self.levels if n > 0), reverse=True)
        found: dict[int, tuple[list[int], list[int], list[int]]] = {n: ([], [], []) for n in levels}
        for k, word in enumerate(words):
            for n in levels:
                units = self.levels[n]
                known = [units[g] for g in grams_of(word, n) if g in units]
                if known:
                    rows, starts, grams = found[n]
                    rows.append(k)
                    starts.append(len(grams))
                    grams += known
                    break
        mean, any_known = np.zeros((len(words), len(self.langs))), np.zeros(len(words), bool)
        for n, (rows, starts, grams) in found.items():
            if rows:
                size = np.diff(starts, append=len(grams))[:, None]
                mean[rows] = np.add.reduceat(self.tables[n][grams], starts, axis=0, dtype=np.float64) / size
                any_known[rows] = True
        return mean, any_known


class Figures:
    """The figures of words by language; those of unseen words are kept from batch to batch."""

    def __init__(self, model: Model):
        self.model = model
        self.words = model.levels.get(0, {})
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.mean, self.known = np.zeros((0, len(self.model.langs))), np.zeros(0, bool)

    def sums(self, bags: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        """For each bag, none empty, the sum of its words' figures and how many words have any."""
        times = np.concatenate([np.fromiter(bag.values(), np.float64, len(bag)) for bag in bags])
        words = [w for bag in bags for w in bag]
        places = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        figures = np.zeros((len(words), len(self.model.langs)))
        seen = places >= 0
        if 0 in self.model.tables:
            figures[seen] = self.model.tables[0][places[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            others = [words[k] for k in rest]
            fresh = [w for w in dict.fromkeys(others) if w not in self.at]
            if len(self.at) + len(fresh) > CACHE:
                self._forget()
                fresh = list(dict.fromkeys(others))
            if fresh:
                mean, known = self.model.unseen(fresh)
                self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
                self.mean, self.known = np.concatenate([self.mean, mean]), np.concatenate([self.known, known])
            index = np.fromiter((self.at[w] for w in others), np.int64, len(others))
            figures[rest] = self.mean[index]
            seen[rest] = self.known[index]
        starts = np.cumsum([0, *(len(bag) for bag in bags[:-1])])
        figures *= times[:, None]
        return np.add.reduceat(figures, starts, axis=0), np.add.reduceat(np.where(seen, times, 0), starts)


def _judge(figures: Figures, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs = figures.model.langs
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)

    def settle(rows: list[int], bags: list[Counter]) -> None:
        total, seen = figures.sums(bags)
        total *= (np.minimum(seen, CERTAIN_WORDS) / np.maximum(seen, 1))[:, None]
        chance = np.exp(total - total.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        for row, k, score in zip(rows, best.tolist(), chance.max(axis=1).tolist(), strict=True):
            labels[row], scores[row] = langs[k], score

    rows, bags, size = [], [], 0
    for row, text in enumerate(texts):
        words = words_of(text) if text and langs else None
        if not words:
            continue
        rows.append(row)
        bags.append(words)
        size += len(words)
        if size >= WORDS_AT_ONCE:
            settle(rows, bags)
            rows, bags, size = [], [], 0
    if rows:
        settle(rows, bags)
    return labels, scores


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from at most `rows` different texts of each language, those of the lowest hashes.

    Rows without text or language teach nothing, and texts that repeat in a language teach
    once; without any rows the model knows nothing.  A language's hashes are ranked by groups
    of tasks first; texts move only when the bound of their language is known.
    """
    some = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    some = some.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    # every task keeps its own lowest hashes before anything is shuffled
    lowest = some.select("lang", "hash", (F.spark_partition_id() % TASK_GROUPS).alias("tasks"))
    for groups in (["lang", "tasks"], ["lang"]):
        order = Window.partitionBy(*groups).orderBy("hash")
        lowest = lowest.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= rows)
        lowest = lowest.select("lang", "hash", *groups[1:]).distinct()
    # a table of one row a language: its size is known before the texts are planned
    bound = cut_lineage(lowest.groupBy("lang").agg(F.max("hash").alias("bound")))
    some = some.join(bound, "lang").where("hash <= bound")
    some = some.groupBy("lang", "hash").agg(F.any_value("text").alias("text"))
    some = some.repartition("lang", "hash").select("lang", "text")
    counts = some.mapInArrow(_counts(LONGEST), "lang string, n int, unit string, count bigint")
    counts = counts.groupBy("lang", "n", "unit").agg(F.sum("count").alias("count"))
    total = Window.partitionBy("n", "unit")
    counts = counts.withColumn("all", F.sum("count").over(total)).where(F.col("all") >= LEAST_COUNT)
    # its size is bounded by the rows above
    return Model.of(counts.select("lang", "n", "unit", "count").toArrow())


def language(model: Model, text: Column, docs: DataFrame) -> Column:
    """struct<lang, score> of a text.

    Each word known to the model counts with its log frequency in every language; a word that
    is not counts with its longest known n-grams.  The score is the winner's share of the
    likelihood of up to CERTAIN_WORDS words, 0 to 1; ties go to the first language by name.
    `und` with score 0 stands for a null text, one without letters, or a model without rows.
    """
    bounded_batches(docs.sparkSession)
    # plain values: the class itself travels with the function
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.levels, model.tables))

    kept: list[Figures] = []

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Figures(Model(*shared.value)))
        labels, scores = _judge(kept[0], texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return judge(text.cast("string"))


def held_out(id_col: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def taught(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Column:
    """The language of each text of `docs`, by a model of its rows outside the held-out fold."""
    model = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    return language(model, F.col(text_col), docs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of `docs` with a struct `language` (lang, score) and `held_out`,
    which replace columns of these names.

    The model learns from the rows outside the held-out fold; predictions see only the text.
    """
    own = [docs[c] for c in docs.columns if c.lower() not in ("language", "held_out")]
    found = taught(docs, id_col, text_col, lang_col)
    return docs.select(*own, found.alias("language"), held_out(F.col(id_col)).alias("held_out"))
