"""Removal of repeated byte strings by sorting suffixes, deep groups by blind tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches, boxed, unboxed
from attestry.llm.hashing import byte_table, mix, powers, signed, text_slices
from attestry.llm.membership import Membership, may_hold_column, membership
from attestry.session import cut_lineage

LENGTH = 100
GRAM = 32
PIECE_BITS = 21
SHALLOW_WORDS = 3
CHUNK_BYTES = 2 << 20
# an anchor with more places than this, and than a ten-thousandth of all, is dealt by window:
# so many contexts, of some 150 bytes each, are what one group may hold in memory
HOT_PLACES = 1 << 15
HOT_SHARE = 10_000
LAST = (1 << 63) - 1


class Anchors:
    """For each string of `length` bytes in a row, the run of strings that share its anchor.

    A string's anchor is its leftmost gram with the smallest hash, which the string's own bytes
    decide: equal strings have equal anchors at equal offsets, wherever they occur.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int, gram: int):
        parts = []
        step = 1 << PIECE_BITS
        for lo in range(0, max(0, len(raw) - length + 1), step):
            piece = raw[lo : lo + step + length - 1]
            parts.append(self._piece(piece, lo, off, length, gram))
        none = np.zeros(0, np.int64)
        self.key, self.first, self.last = (
            np.concatenate([p[k] for p in parts]) if parts else none for k in range(3)
        )

    def _piece(self, raw: np.ndarray, lo: int, off: np.ndarray, length: int, gram: int):
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(byte_table(False)[raw] * up[: len(raw)], out=sums[1:])
        n = len(raw) - gram + 1
        grams = mix((sums[gram:] - sums[:n]) * down[:n])
        low = np.uint64((1 << (PIECE_BITS + 1)) - 1)
        least = (grams & ~low) | np.arange(n, dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have < width:
            shift = min(have, width - have)
            least = np.minimum(least[: len(least) - shift], least[shift:])
            have += shift
        windows = np.arange(len(least)) + lo
        # no string crosses the end of its row
        row_end = off[np.searchsorted(off, windows, "right").clip(max=len(off) - 1)]
        windows = windows[windows + length <= row_end]
        at = (least[windows - lo] & low).astype(np.int64)
        if not len(at):
            return np.zeros(0, np.int64), windows, windows
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(windows) != 1))))
        ends = np.concatenate((new[1:], [len(at)])) - 1
        return signed(grams[at[new]]), windows[new], windows[ends]


def _anchor_counts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in text_slices(batch.column(2)):
                key, n = np.unique(Anchors(raw, off, length, gram).key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """raw[start[i] : start[i] + size[i]] as binary values."""
    off = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    buffers = [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw[at])]
    return pa.Array.from_buffers(pa.binary(), len(size), buffers)


def _contexts(length: int, gram: int, repeated: Membership, hot, by_window: bool):
    """(key, doc, tie, at, bytes): the strings of each anchor that may occur elsewhere.

    With `by_window`, each string of the hot anchors by itself and under its own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hottest = hot.value
        for batch in batches:
            docs, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, raw, off in text_slices(batch.column(2)):
                x = Anchors(raw, off, length, gram)
                pick = np.isin(x.key, hottest)
                pick = pick if by_window else ~pick & repeated.may_hold(x.key)
                key, first, last = x.key[pick], x.first[pick], x.last[pick]
                if by_window:
                    count = last - first + 1
                    begin = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    up, down = powers(len(raw) + 1)
                    both = []
                    for seed in (0, 0xC3A5C85C97CB3127):
                        sums = np.zeros(len(raw) + 1, np.uint64)
                        table = byte_table(False) if not seed else mix(byte_table(False) ^ np.uint64(seed))
                        np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
                        both.append(signed(mix((sums[begin + length] - sums[begin]) * down[begin])))
                    columns = [pa.array(both[0]), pa.array(both[1])]
                else:
                    begin = first
                    columns = [pa.array(key), _gather(raw, first, last - first + length)]
                row = np.searchsorted(off, begin, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        columns[0],
                        pa.array(docs[lo + row].astype(np.int64)),
                        pa.array(ties[lo + row].astype(np.int64)),
                        pa.array(begin - off[row]),
                        columns[1],
                    ],
                    ["key", "doc", "tie", "at", "more" if by_window else "bytes"],
                )

    return run


def equal_strings(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the first start (in the order given) of an equal string, or itself.

    Only raw[start : start + length] counts.  The suffixes are sorted by their first words of
    eight bytes, word by word, and what differs leaves (multikey quicksort to a shallow
    depth).  The groups left share a long prefix; each becomes a blind trie: the common prefix
    of every member with the group's pivot says where it branches off the pivot's path, the
    byte there to which child it goes, and the children are tries of their own.
    """
    same = np.arange(len(starts))
    words = np.zeros(len(raw) + 8, np.uint64)
    padded = np.concatenate((raw, np.zeros(16, np.uint8))).astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)

    def split(members: np.ndarray, *by: np.ndarray) -> np.ndarray:
        """Sort by group and `by`, make what agrees the new groups, drop groups of one."""
        order = np.lexsort((*by[::-1], group[members]))
        members = members[order]
        fresh = np.zeros(len(members), bool)
        fresh[:1] = True
        for column in (group[members], *(b[order] for b in by)):
            fresh[1:] |= column[1:] != column[:-1]
        ids = np.cumsum(fresh) - 1
        stay = np.bincount(ids, minlength=1)[ids] > 1 if len(ids) else fresh
        group[members] = ids
        return members[stay]

    shallow = min(SHALLOW_WORDS, length // 8)
    for k in range(shallow):
        live = split(live, words[starts[live] + 8 * k])
    depth = 8 * shallow
    if depth == length or not len(live):
        tails = None
    else:
        tails = np.lib.stride_tricks.sliding_window_view(raw[depth:], length - depth)
    while len(live):
        head = np.concatenate(([True], group[live][1:] != group[live][:-1]))
        pivot = live[head][np.cumsum(head) - 1]
        common = np.full(len(live), length, np.int64)
        if tails is not None:
            for lo in range(0, len(live), 100_000):
                part = slice(lo, lo + 100_000)
                differ = tails[starts[live[part]]] != tails[starts[pivot[part]]]
                where = differ.argmax(axis=1)
                common[part] = np.where(differ[np.arange(len(where)), where], depth + where, length)
        equal = common == length
        same[live[equal]] = pivot[equal]
        rest, common = live[~equal], common[~equal]
        live = split(rest, common, raw[starts[rest] + common])
    return same


def _repeats(keys: np.ndarray, docs, ties, ats, contexts: pa.Array, length: int) -> pa.RecordBatch:
    """The merged ranges of the strings that occur earlier, among contexts of whole groups."""
    off = np.frombuffer(contexts.buffers()[1], np.int32, len(contexts) + 1, contexts.offset * 4).astype(np.int64)
    raw = np.frombuffer(contexts.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    count = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, tie, at = docs[row], ties[row], ats[row] + inner
    same = equal_strings(raw, off[row] + inner, length)
    order = np.lexsort((at, tie, doc, same))
    doc, tie, at, same = doc[order], tie[order], at[order], same[order]
    head = np.concatenate(([True], same[1:] != same[:-1]))[: len(same)]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc != doc[first]) | (tie != tie[first]) | (at != at[first])
    doc, tie, at = doc[later], tie[later], at[later]
    order = np.lexsort((at, tie, doc))
    return _ranges(doc[order], tie[order], at[order], length)


def _ranges(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    if len(doc):
        apart = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + length)
        head = np.concatenate(([True], apart))
        tail = np.concatenate((apart, [True]))
        doc, tie, lo, hi = doc[head], tie[head], at[head], at[tail] + length
    else:
        lo = hi = at
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, tie, lo, hi)], ["doc", "tie", "lo", "hi"])


def _sorted_groups(length: int):
    """Batches sorted by key come in; whole groups are worked on, a bounded number at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            columns = [part.column(k).combine_chunks() if part.num_rows else None for k in range(5)]
            if not part.num_rows:
                none = np.zeros(0, np.int64)
                return _ranges(none, none, none, length)
            numbers = [c.to_numpy(zero_copy_only=False) for c in columns[:4]]
            return _repeats(*numbers, columns[4], length)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(4).nbytes
            if size < CHUNK_BYTES:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            # the last group may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                at = 0
                while at < cut:
                    end = min(cut, at + max(1, int(cut * CHUNK_BYTES / max(size, 1))))
                    while end < cut and keys[end] == keys[end - 1]:
                        end += 1
                    yield work(table.slice(at, end - at))
                    at = end
            held = table.slice(cut).to_batches()
            size = sum(b.column(4).nbytes for b in held)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def repeated_ranges(docs: DataFrame, length: int, gram: int, hot_places: int) -> DataFrame:
    """(doc, tie, lo, hi): ranges of bytes covered by strings that start earlier."""
    counts = docs.mapInArrow(_anchor_counts(length, gram), "key bigint, n bigint")
    counts = cut_lineage(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot_places, total // HOT_SHARE)
    # fewer than HOT_SHARE keys have more than a HOT_SHARE-th of all places
    hot_keys = counts.where(F.col("n") > least).select("key").toArrow()["key"].to_numpy()
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(hot_keys))
    repeated = membership(counts)
    schema = "key bigint, doc bigint, tie bigint, at bigint, bytes binary"
    contexts = docs.mapInArrow(_contexts(length, gram, repeated, hot, False), schema)
    ranges = "doc bigint, tie bigint, lo bigint, hi bigint"
    usual = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(length), ranges)
    if not len(hot_keys):
        return usual
    schema = "key bigint, doc bigint, tie bigint, at bigint, more bigint"
    windows = cut_lineage(docs.mapInArrow(_contexts(length, gram, repeated, hot, True), schema))
    here = F.struct("doc", "tie", "at")
    first = windows.groupBy("key", "more").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    later = windows.join(first.where("first <> last"), ["key", "more"]).where(here != F.col("first"))
    return usual.union(later.select("doc", "tie", F.col("at").alias("lo"), (F.col("at") + length).alias("hi")))


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal runs: what overlaps or touches is one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[head], hi[np.concatenate((head[1:], [True]))]


CUT = "struct<spans:array<struct<lo:bigint,hi:bigint>>,kept:binary>"


def _cut():
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        spans, kept = [], []
        for text, ranges in zip(texts, gone, strict=True):
            raw, found = text.as_py().encode(), ranges.values
            if found is None or not len(found):
                spans.append([])
                kept.append(raw)
                continue
            lo, hi = _merged(found.field("lo").to_numpy(), found.field("hi").to_numpy())
            spans.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["spans", "kept"])

    return cut


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot_places: int = HOT_PLACES,
    into: str = "cut",
) -> DataFrame:
    """All rows and columns of `docs` with a struct `into`: n_bytes, spans (maximal removed
    ranges of bytes) and kept (the other bytes).

    Texts are UTF-8 bytes, null is empty.  A byte goes if a string of `length` bytes covers it
    that also starts earlier: in a document of smaller id, or before in the same one.  Strings
    are judged on the input.  Rows without id come last; rows that share an id are ordered by
    a hash of their text, and are one document if the texts are equal.

    Copies of a whole text are found by hash and need no suffixes.  The other strings are dealt
    by an anchor gram that their own bytes choose, so equal strings meet in one task, where
    their suffixes are sorted; only anchors that occur again are dealt at all.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    rows = docs.select(boxed(docs)).select(
        "row",
        F.coalesce(F.col("row")[id_col].cast("bigint"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("tie"),
        F.xxhash64(text, F.lit(1)).alias("tie2"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    known = rows.where(F.col("n_bytes") >= length).select("doc", "tie", "tie2", "n_bytes")
    known = cut_lineage(known.distinct())
    firsts = known.groupBy("tie", "tie2", "n_bytes").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    copies = known.join(firsts.where("first <> last"), ["tie", "tie2", "n_bytes"]).where("doc <> first")
    copies = cut_lineage(copies.select("doc", "tie"))

    def pair() -> Column:
        return F.xxhash64("doc", "tie")

    copied = membership(copies.select(pair().alias("key")))
    plain = rows.where(F.col("n_bytes") >= length).select("doc", "tie", text.alias("text"))
    sure = ~may_hold_column(copied, pair())
    # only what may be a copy is shuffled to make certain
    doubtful = plain.where(~sure).join(copies, ["doc", "tie"], "left_anti").select("doc", "tie", "text")
    ranges = repeated_ranges(plain.where(sure).union(doubtful), length, gram, hot_places)
    gone = ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    whole = known.join(copies, ["doc", "tie"], "left_semi").select("doc", "tie", F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n_bytes").alias("hi"))).alias("gone"))
    gone = cut_lineage(gone.union(whole))
    holds = membership(gone.select(pair().alias("key")))
    maybe = may_hold_column(holds, pair())
    span = "array<struct<lo:bigint,hi:bigint>>"
    clean = rows.where(~maybe).select("row", "n_bytes", F.array().cast(span).alias("spans"), text.cast("binary").alias("kept"))
    some = rows.where(maybe).drop("tie2").join(gone, ["doc", "tie"], "left")
    some = some.select("row", "n_bytes", _cut()(text, F.coalesce("gone", F.array().cast(span))).alias("c"))
    done = clean.union(some.select("row", "n_bytes", "c.spans", "c.kept"))
    return unboxed(done, docs.columns, **{into: F.struct("n_bytes", "spans", "kept")})
