"""Benchmark decontamination: BM25 over test items with block-max pruning, then exact overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches
from attestry.llm.hashing import byte_table, long_lists, mix, run_hashes, seeded, signed, text_slices, word_bounds

WIDTH = 5
OVERLAP = 0.75
K1, B = 1.2, 0.75
LEAST_PASSAGE = 128
BLOCK = 16
# an index is broadcast, so it holds the items of at most so many bytes of text; more items
# make more indexes, each of which every passage queries
INDEX_BYTES = 16 << 20
# terms in a larger share of the items never make a candidate by themselves
COMMON = 0.125

# runs of ASCII letters, digits and whatever is not ASCII
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

HIT = "array<struct<item:bigint,passage:bigint,score:double,question:double,answer:double>>"


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) of the lower-cased texts."""
    for lo, hi, raw, off in text_slices(pc.utf8_lower(texts)):
        starts, ends, first = word_bounds(raw, off, IN_WORD)
        yield lo, hi, run_hashes(byte_table(False)[raw], starts, ends), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n or n == 0:
        return np.zeros(0, np.uint64)
    factors, total = seeded(n, 19), np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * factors[k]
    return mix(total + np.uint64(n))


def _item_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            columns: list[list] = [[np.zeros(0, np.uint64)] * count for _ in range(2)]
            for column, name in ((0, "question"), (1, "answer")):
                for lo, hi, words, first in hashed_words(batch.column(name)):
                    for row in range(lo, hi):
                        columns[column][row] = words[first[row - lo] : first[row - lo + 1]]
            both = [np.concatenate(w) for w in zip(*columns, strict=True)]
            grams_of = [[signed(np.unique(grams(w, min(width, len(w))))) for w in part] for part in columns]
            sizes = [[min(width, len(w)) for w in part] for part in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), long_lists([signed(w) for w in both]), *map(long_lists, grams_of), *(pa.array(s, pa.int32()) for s in sizes)],
                ["item", "words", "question", "answer", "question_n", "answer_n"],
            )

    return run


class Index:
    """An inverted index of items: postings in blocks, with the most a term adds in each."""

    def __init__(self, rows: list, idf: dict[int, float], items: int, mean: float, overlap: float, longest: int):
        self.passage = max(LEAST_PASSAGE, 2 * longest)
        self.stride = self.passage // 2
        weights = []
        for r in rows:
            terms, tf = np.unique(np.array(r["words"], np.int64), return_counts=True)
            norm = K1 * (1 - B + B * len(r["words"]) / mean)
            w = np.array([idf[t] for t in terms.tolist()]) * tf * (K1 + 1) / (tf + norm)
            # of an item that overlaps enough, at most so many words are missing: one for each
            # missing shingle, and n - 1 more for a part whose shingles of n words may all miss
            total = len(r["question"]) + len(r["answer"])
            missing = math.floor((1 - overlap) * total + 1e-9)
            missing += sum(r[f"{c}_n"] - 1 for c in ("question", "answer") if 0 < len(r[c]) <= missing)
            least = w.sum() - np.sort(w)[::-1][:missing].sum()
            weights.append((least, r, terms, w))
        weights.sort(key=lambda x: (x[0], x[1]["item"]))
        self.item = np.array([x[1]["item"] for x in weights], np.int64)
        self.least = np.array([x[0] for x in weights])
        self.parts = [
            tuple((np.array(x[1][c], np.int64), x[1][f"{c}_n"]) for c in ("question", "answer")) for x in weights
        ]
        self.terms = np.unique(np.concatenate([x[2] for x in weights]).view(np.uint64))
        item = np.repeat(np.arange(len(weights)), [len(x[2]) for x in weights])
        term = np.searchsorted(self.terms, np.concatenate([x[2] for x in weights]).view(np.uint64))
        weight = np.concatenate([x[3] for x in weights])
        df = np.bincount(term, minlength=len(self.terms))
        self.common = df > max(1, COMMON * items)
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, term, weight)
        # postings by block of items and term
        order = np.lexsort((item, term, item // BLOCK))
        self.post_item, self.post_weight = item[order], weight[order]
        keys = (item // BLOCK)[order] * len(self.terms) + term[order]
        self.keys, self.begin = np.unique(keys, return_index=True)
        self.end = np.append(self.begin[1:], len(keys))
        self.block_most = np.maximum.reduceat(self.post_weight, self.begin)
        self.block_least = self.least[::BLOCK]
        # the blocks of each rare term
        rare = ~self.common[self.keys % len(self.terms)]
        order = np.argsort((self.keys % len(self.terms))[rare], kind="stable")
        self.rare_key = np.flatnonzero(rare)[order]
        of = (self.keys % len(self.terms))[self.rare_key]
        self.rare_begin = np.searchsorted(of, np.arange(len(self.terms) + 1))

    def plain(self) -> dict:
        return dict(self.__dict__)

    def passages(self, first: np.ndarray):
        """Each row's first passage number and how many it has."""
        size = np.diff(first)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - self.passage) // self.stride)), 0)
        return np.cumsum(count) - count, count

    def candidates(self, words: np.ndarray, first: np.ndarray):
        """(passage, item, score) of all items whose score in a passage reaches their least."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[at] == words)
        row = np.searchsorted(first, hit, "right") - 1
        place = hit - first[row]
        begin, count = self.passages(first)
        last = place // self.stride
        # a word lies in up to two passages
        own, prior = np.minimum(last, count[row] - 1), last - 1
        two = (prior >= 0) & (prior < own) & (place < prior * self.stride + self.passage)
        inside = place < own * self.stride + self.passage
        v = len(self.terms)
        pair = np.unique(
            np.concatenate(
                ((begin[row[inside]] + own[inside]) * v + at[hit[inside]], (begin[row[two]] + prior[two]) * v + at[hit[two]])
            )
        )
        passage, term = pair // v, pair % v
        total = int(count.sum())
        # list level: what common terms add at most
        common = self.common[term]
        base = np.bincount(passage[common], self.most[term[common]], total)
        # block level: what a passage's rare terms add at most to any item of a block
        p, t = passage[~common], term[~common]
        n = self.rare_begin[t + 1] - self.rare_begin[t]
        key = self.rare_key[np.repeat(self.rare_begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        blocks = len(self.block_least)
        cell = np.repeat(p, n) * blocks + self.keys[key] // v
        cells, inverse = np.unique(cell, return_inverse=True)
        bound = np.bincount(inverse, self.block_most[key], len(cells)) + base[cells // blocks]
        cells = cells[bound >= self.block_least[cells % blocks] - 1e-9]
        # common terms alone may do for the items that ask least; those come first
        enough = np.searchsorted(self.block_least, base + 1e-9, "right")
        more = np.repeat(np.arange(total) * blocks - np.cumsum(enough) + enough, enough) + np.arange(enough.sum())
        cells = np.union1d(cells, more)
        # postings of the blocks that are left
        starts = np.searchsorted(passage, np.arange(total + 1))
        p, b = cells // blocks, cells % blocks
        n = starts[p + 1] - starts[p]
        of = np.repeat(np.arange(len(cells)), n)
        t = term[np.repeat(starts[p] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        want = b[of] * v + t
        k = np.searchsorted(self.keys, want)
        k[k == len(self.keys)] = 0
        good = self.keys[k] == want
        k, of = k[good], of[good]
        n = self.end[k] - self.begin[k]
        post = np.repeat(self.begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(np.repeat(of, n) * BLOCK + self.post_item[post] % BLOCK, self.post_weight[post], len(cells) * BLOCK)
        found = np.flatnonzero(score > 0)
        item = b[found // BLOCK] * BLOCK + found % BLOCK
        enough = score[found] >= self.least[item] - 1e-9
        found, item = found[enough], item[enough]
        return p[found // BLOCK], item, score[found]

    def hits(self, words: np.ndarray, first: np.ndarray, overlap: float) -> list[list[dict]]:
        """For each row, the best passage of every item that overlaps it enough."""
        out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
        begin, count = self.passages(first)
        ends = begin + count
        cache: dict[tuple[int, int], np.ndarray] = {}
        before = -1
        for passage, item, score in sorted(zip(*(x.tolist() for x in self.candidates(words, first)), strict=True)):
            if passage != before:
                cache, before = {}, passage
            row = int(np.searchsorted(ends, passage, "right"))
            number = passage - int(begin[row])
            lo = int(first[row]) + number * self.stride
            hi = min(int(first[row + 1]), lo + self.passage)
            shares, shared, total = [], 0, 0
            for members, n in self.parts[item]:
                if n not in cache:
                    cache[n] = signed(grams(words[lo:hi], n))
                here = int(np.isin(members, cache[n]).sum())
                shares.append(here / len(members) if len(members) else None)
                shared, total = shared + here, total + len(members)
            if total and shared + 1e-9 >= overlap * total:
                found = {"item": int(self.item[item]), "passage": number, "score": score, "question": shares[0], "answer": shares[1]}
                same = [x for x in out[row] if x["item"] == found["item"]]
                if not same:
                    out[row].append(found)
                elif same[0]["score"] < score:
                    same[0].update(found)
        return [sorted(x, key=lambda h: h["item"]) for x in out]


def _restored(state: dict) -> Index:
    index = Index.__new__(Index)
    index.__dict__.update(state)
    return index


def indexes(items: DataFrame, id_col: str, question: Column, answer: Column, overlap: float, most: int) -> list[Index]:
    """Indexes over all items, each of at most about `most` bytes of item text."""
    plain = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("item"),
        F.coalesce(question.cast("string"), F.lit("")).alias("question"),
        F.coalesce(answer.cast("string"), F.lit("")).alias("answer"),
    )
    plain = plain.dropDuplicates()
    size = plain.agg(F.sum(F.octet_length("question") + F.octet_length("answer"))).first()[0] or 0
    shards = 1 + size // most
    schema = "item bigint, words array<bigint>, question array<bigint>, answer array<bigint>, question_n int, answer_n int"
    rows = plain.mapInArrow(_item_rows(WIDTH), schema).where(F.size("words") > 0)
    total = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("longest")).first()
    if not total["n"]:
        return []
    df = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log1p((total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    out = []
    for shard in range(shards):
        # a shard's rows are bounded by its bytes of text
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        terms = some.select(F.explode("words").alias("term")).distinct().join(idf, "term")
        weights = {r["term"]: r["idf"] for r in terms.collect()}
        held = some.collect()
        if held:
            out.append(Index(held, weights, total["n"], total["mean"], overlap, total["longest"]))
    return out


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    id_col: str = "item_id",
    question: Column | None = None,
    answer: Column | None = None,
    overlap: float = OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> Column:
    """A column over `docs`: the test items that a text leaks, with the best passage's figures.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.  A passage
    is a window of a fixed number of words (twice the longest item, LEAST_PASSAGE or more);
    windows start every half window, so a copy of an item lies in one.  An item leaks if a
    passage holds at least `overlap` of the distinct 5-word shingles of its question and
    answer together (a part with fewer words is one shingle).

    Every passage queries a BM25 index of the items.  An item's least score is what any passage
    with enough overlap must reach, so retrieval loses none: it is the score of the whole item
    without its heaviest words, as many as may be missing.  Bounds by list and by block skip
    most postings; what reaches its least score is verified word by word.

    Null or blank texts leak nothing; items without id or words are ignored, repeated items
    count once.  A second item under the same id is one more way to match that id.
    """
    question = F.col("text") if question is None else question
    answer = F.lit(None).cast("string") if answer is None else answer
    bounded_batches(docs.sparkSession)
    found = indexes(items, id_col, question, answer, overlap, index_bytes)
    text = F.col(text_col).cast("string")
    if not found:
        return F.array().cast(HIT)

    def one(index: Index) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(index.plain())

        @F.arrow_udf(HIT)
        def search(texts: pa.Array) -> pa.Array:
            held, out = _restored(shared.value), [[]] * len(texts)
            for lo, hi, words, first in hashed_words(texts):
                out[lo:hi] = held.hits(words, first, overlap)
            kind = pa.struct([("item", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])
            return pa.array(out, pa.list_(kind))

        return search(text)

    return F.concat(*[one(index) for index in found]) if len(found) > 1 else one(found[0])


# The last sentence of an item stands for its answer.
PARTS = r"(?s)^(.*[.!?])\s+([^.!?]+[.!?]*)\s*$"


def item_parts(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item that is one text: all but the last sentence, and that."""
    answer = F.regexp_extract(text, PARTS, 2)
    return F.when(answer == "", text).otherwise(F.regexp_extract(text, PARTS, 1)), answer
