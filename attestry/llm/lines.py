"""Line deduplication: an edit-distance join of lines by segment partition."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches, boxed, unboxed
from attestry.llm.graph import link_groups
from attestry.llm.hashing import long_lists, mix, powers, row_slices, seeded, signed, text_buffer
from attestry.llm.membership import Membership, may_hold_column, membership
from attestry.session import by_merge, cut_lineage

EDITS = 2
# a line may differ by one character for each so many of its own
CHARS_PER_EDIT = 20
SLICE_CHARS = 1 << 18
# lines that still share a segment across components are cut into so many more segments than
# edits, all of which must match
MATCHING = 3
# beyond these edits a line has too many ways to hold them
FINER_EDITS = 3
# ids that meet in a key with more ids than this are cut into so many pieces instead, of which
# all but those with an edit must match
CROWD = 8
WIDE, NARROW = 16, 4
ENTRY_ROWS = 1 << 17


def allowed_edits(length: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    return np.minimum(edits, length // per_edit)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments a line is cut into, the short ones first."""
    n = edits + 1
    size, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        step = size + (1 if i >= n - longer else 0)
        out.append((at, step))
        at += step
    return out


def probe_starts(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size): where a line of `length` can hold a segment of one of `other`.

    Of the alignments of two lines within `edits` edits, those that leave the segment's left
    part to at most `segment` edits, or its right part to the remaining ones; one alignment
    of every such pair is among them.  `other` is at most `length`.
    """
    diff, out = length - other, []
    for i, (p, size) in enumerate(segments(other, edits)):
        lo = max(0, p - i, p + diff - (edits - i))
        hi = min(length - size, p + i, p + diff + (edits - i))
        out += [(i, s, size) for s in range(lo, hi + 1)]
    return out


def cuts(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i, for many lengths: `segments` over arrays."""
    size, longer = np.divmod(length, tau + 1)
    plain = tau + 1 - longer
    return i * size + np.maximum(0, i - plain), size + (i >= plain)


def shifts(between: int, diff: int, tau: int) -> list[tuple[int, ...]]:
    """How far the parts of a line lie further on in one that is `diff` longer, where tau edits
    lie in the gaps between the parts: the first one not at all, the last one by `diff`, and
    every change of the shift costs its size."""
    paths = [((0,), 0)]
    for _ in range(between):
        paths = [((*p, s), cost + abs(s - p[-1])) for p, cost in paths for s in range(-tau, tau + 1)]
    return [(*p, diff) for p, cost in paths if cost + abs(diff - p[-1]) <= tau]


def gaps(tau: int, fine: bool) -> tuple[int, list[list[tuple[int, int]]]]:
    """Into how many pieces a line is cut, and every list of gaps (first piece, end) of a key.

    Wherever tau edits lie, the gaps of one list hold them all.  Coarse pieces are few and give
    few keys.  Fine gaps hold little of the line: two edits lie in two narrow pieces that are near
    each other, or in two wide ones that are not.
    """
    if not fine or tau > 2:
        n = tau + MATCHING
        chosen = [[(i, i + 1) for i in c] for c in combinations(range(n), tau)]
    elif tau == 1:
        n = WIDE
        chosen = [[(i, i + 1)] for i in range(n)]
    else:
        n, k = WIDE * NARROW, NARROW
        chosen = [[(a, a + 1), (b, b + 1)] for a, b in combinations(range(n), 2) if b // k - a // k <= 1]
        chosen += [[(a * k, a * k + k), (b * k, b * k + k)] for a, b in combinations(range(WIDE), 2) if b - a > 1]
    merged = []
    for some in chosen:
        out = some[:1]
        for a, b in some[1:]:
            out = [*out[:-1], (out[-1][0], b)] if out[-1][1] == a else [*out, (a, b)]
        merged.append(out)
    return n, merged


class Lines:
    """The lines of some texts as code points, with their hashes."""

    def __init__(self, texts: list[str], edits: int, per_edit: int):
        row, number, parts = [], [], []
        for r, text in enumerate(texts):
            for k, line in enumerate(text.split("\n")):
                line = line.strip(" \t\r\f\v")
                # shorter lines may not differ, and are too common to be copies of each other
                if len(line) >= per_edit:
                    row.append(r)
                    number.append(k)
                    parts.append(line)
        self.row, self.number, self.parts = np.array(row, np.int64), np.array(number, np.int64), parts
        self.length = np.array([len(p) for p in parts], np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        up, self.down = powers(len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=self.sums[1:])
        self.id = signed(mix(self.hashes(self.start, self.length) ^ self.length.astype(np.uint64)))
        self.most, self.per_edit = edits, per_edit

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def digests(self) -> np.ndarray:
        """A second hash of each line."""
        return np.array(
            [int.from_bytes(blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for p in self.parts],
            np.int64,
        )

    def _key(self, lines: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, tau: int, i: int) -> np.ndarray:
        """The key of a substring that stands for segment i of lines of length `other`."""
        got = self.hashes(self.start[lines] + at, size)
        return signed(mix(mix(got) + other.astype(np.uint64) * seeded(1, 3)[0] + np.uint64(64 * tau + i)))

    def index_keys(self) -> np.ndarray:
        """A row for each line, a key for each of its segments; unused places hold 0."""
        out = np.zeros((len(self.length), self.most + 1), np.int64)
        taus = allowed_edits(self.length, self.most, self.per_edit)
        for tau in np.unique(taus).tolist():
            lines = np.flatnonzero(taus == tau)
            for i in range(tau + 1):
                at, size = cuts(self.length[lines], tau, i)
                out[lines, i] = self._key(lines, at, size, self.length[lines], tau, i)
        return out

    def probes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(line, key) for each substring that may equal a segment of another, no longer line.

        The shorter line's length says how it is cut, so both sides use its number of edits.
        A line's own segments are no probes: as index keys they meet already.
        """
        for diff in range(self.most + 1):
            other = self.length - diff
            taus = allowed_edits(other, self.most, self.per_edit)
            for tau in range(max(1, diff), self.most + 1):
                lines = np.flatnonzero(taus == tau)
                length, short = self.length[lines], other[lines]
                for i in range(tau + 1):
                    p, size = cuts(short, tau, i)
                    lo = np.maximum(0, np.maximum(p - i, p + diff - (tau - i)))
                    hi = np.minimum(length - size, np.minimum(p + i, p + diff + (tau - i)))
                    for k in range(int((hi - lo).max(initial=-1)) + 1):
                        fits = (lo + k <= hi) & ((diff > 0) | (lo + k != p))
                        chosen = lines[fits]
                        yield chosen, self._key(chosen, (lo + k)[fits], size[fits], short[fits], tau, i)


    def combined(self, fine: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(line, key, own) for all of a line but the pieces its edits may lie in.

        An edit lies in a piece of the shorter line, an added character in the piece it stands
        before.  What lies between two such pieces is whole in both lines, so two lines that link
        share a key of which one side is its own.  The other side's key takes the parts at
        shifted places.
        """
        factor = seeded(2 + self.most, 2)
        for diff in range(self.most + 1):
            other = self.length - diff
            taus = allowed_edits(other, self.most, self.per_edit)
            for tau in range(max(1, diff), self.most + 1):
                lines = np.flatnonzero(taus == tau)
                if not len(lines):
                    continue
                n, chosen = gaps(tau, fine)
                starts = [cuts(other[lines], n - 1, i)[0] for i in range(n)] + [other[lines]]
                salt = 1 << 16
                for which, some in enumerate(chosen):
                    ends = [*some, (n, n)]
                    parts = [(a, b) for (_, a), (b, _) in zip([(0, 0), *some], ends, strict=True)]
                    for shift in shifts(len(some) - 1, diff, tau):
                        at = [starts[a] + s for (a, _), s in zip(parts, shift, strict=True)]
                        size = [starts[b] - starts[a] for a, b in parts]
                        fits = np.ones(len(lines), bool)
                        for a, b in zip(at, size, strict=True):
                            fits &= (a >= 0) & (a + b <= self.length[lines])
                        held = lines[fits]
                        key = other[held].astype(np.uint64) * factor[0] + np.uint64(salt * (2 * tau + fine) + which)
                        for f, a, b in zip(factor[1:], at, size, strict=False):
                            key = mix(key) + mix(self.hashes(self.start[held] + a[fits], b[fits])) * f
                        yield held, signed(mix(key)), diff == 0 and not any(shift)


def _line_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    _, off = text_buffer(batch.column(1))
    for lo, hi in row_slices(np.diff(off), SLICE_CHARS):
        yield lo, [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]


def _line_rows(edits: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, texts in _line_slices(batch):
                x = Lines(texts, edits, per_edit)
                if not len(x.row):
                    continue
                keys = x.index_keys()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.id),
                        pa.array(x.digests()),
                        pa.array(ids[lo + x.row].astype(np.int64)),
                        pa.array(x.number),
                        long_lists(list(keys)),
                    ],
                    ["id", "second", "doc", "line", "keys"],
                )

    return run


def _probe_entries(edits: int, per_edit: int, index: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _line_slices(batch):
                x = Lines(texts, edits, per_edit)
                keys, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for line, key in x.probes():
                    hit = index.may_hold(key)
                    keys.append(key[hit])
                    ids.append(x.id[line[hit]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    return run


def _texts_of(edits: int, per_edit: int, wanted: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _line_slices(batch):
                x = Lines(texts, edits, per_edit)
                if not len(x.row):
                    continue
                ids, first = np.unique(x.id, return_index=True)
                hit = wanted.may_hold(ids)
                parts = [x.parts[k] for k in first[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(parts, pa.string())], ["id", "text"])

    return run


def _combined_entries(edits: int, per_edit: int, fine: bool, index: Membership | None = None):
    """A line's own keys, or with the filter of all own keys the others that may be among them."""

    def rows(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, n = [], [], 0
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for lo, hi in row_slices(np.diff(off), SLICE_CHARS):
                x = Lines(batch.column(1).slice(lo, hi - lo).to_pylist(), edits, per_edit)
                for line, key, own in x.combined(fine):
                    if own != (index is None):
                        continue
                    hit = np.ones(len(key), bool) if own else index.may_hold(key)
                    keys.append(key[hit])
                    ids.append(x.id[line[hit]])
                    n += len(keys[-1])
                    if n >= ENTRY_ROWS:
                        yield rows(keys, ids)
                        keys, ids, n = [], [], 0
        if n:
            yield rows(keys, ids)

    return run


def may_link(left: list[str], right: list[str], edits: np.ndarray) -> np.ndarray:
    """Whether the characters of each pair, as counts by 64 classes, allow so few edits.

    An edit changes the counts by two at most, so pairs that are left out never link.
    """

    def counts(texts: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return np.bincount(row * 64 + (flat & 63), minlength=64 * len(texts)).reshape(-1, 64)

    return np.abs(counts(left) - counts(right)).sum(axis=1) <= 2 * edits


def within_edits(left: list[str], right: list[str], edits: np.ndarray) -> np.ndarray:
    """Whether each pair of strings is within its number of edits, many pairs at once.

    Bit-parallel over a diagonal band: each pair has one 64-bit word whose top bits stand for
    the diagonals -edits .. edits, and one round of word operations moves all bands on by a
    character.  `edits` is at most 31.
    """
    longer = [a if len(a) >= len(b) else b for a, b in zip(left, right, strict=True)]
    shorter = [b if len(a) >= len(b) else a for a, b in zip(left, right, strict=True)]
    m = np.array([len(s) for s in longer], np.int64)
    n = np.array([len(s) for s in shorter], np.int64)
    out = np.zeros(len(m), bool)
    todo = np.flatnonzero(m - n <= edits)
    for tau in np.unique(edits[todo]):
        rows = todo[edits[todo] == tau]
        rows = rows[np.argsort(n[rows], kind="stable")]
        size = np.cumsum(m[rows] + 8)
        for lo, hi in row_slices(np.diff(size, prepend=0), SLICE_CHARS):
            some = rows[lo:hi]
            out[some] = _band([longer[k] for k in some], [shorter[k] for k in some], int(tau)) <= tau
    return out


def _padded(texts: list[str], before: int, after: int, fill: int) -> np.ndarray:
    """One column for each text, so that a step over all texts reads one row."""
    width = max(map(len, texts), default=0)
    grid = np.full((len(texts), before + width + after), fill, np.int32)
    for k, s in enumerate(texts):
        grid[k, before : before + len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return np.ascontiguousarray(grid.T)


def _band(longer: list[str], shorter: list[str], tau: int) -> np.ndarray:
    """The edit distance of each pair where it is at most tau, else some number above tau."""
    m = np.array([len(s) for s in longer], np.int64)
    n = np.array([len(s) for s in shorter], np.int64)
    if tau == 0:
        return np.array([a != b for a, b in zip(longer, shorter, strict=True)], np.int64)
    one, top = np.uint64(1), np.uint64(63)
    pattern = _padded(longer, tau, 2 * tau + 1, -1)
    text = _padded(shorter, 0, 0, -2)
    up = np.full(len(m), (2**64 - 1) ^ ((1 << (63 - tau)) - 1), np.uint64)
    down = np.zeros(len(m), np.uint64)
    score = np.full(len(m), tau, np.int64)
    for i in range(text.shape[0]):
        match = np.zeros(len(m), np.uint64)
        for d in range(2 * tau + 1):
            # the pattern's character i - tau + d lies on diagonal d
            if i + d < pattern.shape[0]:
                match |= (pattern[i + d] == text[i]).astype(np.uint64) << np.uint64(63 - 2 * tau + d)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(diagonal | up)
        right_down = diagonal & up
        # down the lowest diagonal until it leaves the pattern, then along the last row
        past = i - (m - tau)
        bit = np.clip(62 - past, 0, 62).astype(np.uint64)
        along = ((right_up >> bit) & one).astype(np.int64) - ((right_down >> bit) & one).astype(np.int64)
        change = np.where(past < 0, 1 - ((diagonal >> top) & one).astype(np.int64), along)
        score += np.where(i < n, change, 0)
        shifted = diagonal >> one
        up, down = right_down | ~(shifted | right_up), shifted & right_up
    return score


def _checked(edits: int, per_edit: int):
    def verified(pairs: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
        left, right = [p[2] for p in pairs], [p[3] for p in pairs]
        shorter = np.array([min(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64)
        good = np.flatnonzero(within_edits(left, right, allowed_edits(shorter, edits, per_edit))).tolist()
        ids = [pa.array([pairs[k][side] for k in good], pa.int64()) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(ids, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a step over many pairs costs as much as one over a few
        waiting, chars = [], 0
        for batch in batches:
            lengths = sum(np.diff(text_buffer(batch.column(c))[1]) for c in (2, 3))
            for lo, hi in row_slices(lengths, SLICE_CHARS):
                a, b, left, right = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in range(4))
                shorter = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
                for k in np.flatnonzero(may_link(left, right, allowed_edits(shorter, edits, per_edit))).tolist():
                    waiting.append((a[k], b[k], left[k], right[k]))
                    chars += len(left[k]) + len(right[k])
                if chars >= 4 * SLICE_CHARS:
                    yield verified(waiting)
                    waiting, chars = [], 0
        if waiting:
            yield verified(waiting)

    return run


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits: int = EDITS,
    per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """(doc, line, near) of every line that repeats an earlier one; lines count from 0.

    Lines are cut at \\n and compared without ASCII blanks at their ends, by code points.
    Lines of at least `per_edit` characters link if their edit distance is at most
    min(edits, shorter length // per_edit); the first line of a component by (id, line)
    stays, all others are repeated.  `near` says that no equal line is earlier.  Shorter lines
    and rows without id are never repeated; rows that repeat an id count as one document.

    An index holds each line's edits + 1 segments by line length; substrings of a line probe
    it at the starts where a segment of a line up to `edits` shorter can lie.  Pairs that meet
    are verified with a banded bit-parallel edit distance.  Lines that share a segment with
    other components to the end are cut into edits + MATCHING segments, of which MATCHING must
    match at once; those that then meet in a crowd must match in all but the small pieces their
    edits lie in.  Above FINER_EDITS edits they meet by single segments.  Lines are known by 64-bit hashes
    while they are joined, and by 128 bits where equal ones are counted as one.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    lines = "id bigint, second bigint, doc bigint, line bigint, keys array<bigint>"
    rows = cut_lineage(plain.mapInArrow(_line_rows(edits, per_edit), lines))
    # equal lines have equal keys: any one of them speaks for all
    firsts = rows.groupBy("id", "second").agg(
        F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("times"), F.expr("any_value(keys)").alias("keys")
    )
    firsts = cut_lineage(firsts)
    own = firsts.select("id", F.explode("keys").alias("key")).where("key <> 0")
    lists = cut_lineage(own.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    index = membership(lists)
    probes = plain.mapInArrow(_probe_entries(edits, per_edit, index), "key bigint, id bigint").distinct()
    # a probe that meets no segment has nothing to say
    probes = cut_lineage(probes.join(lists.select("key"), "key", "left_semi"))
    useful = lists.where("lo <> hi").select("key").union(probes.select("key")).distinct()
    useful = cut_lineage(useful)
    own = own.where(may_hold_column(membership(useful), F.col("key"))).join(useful, "key", "left_semi")
    entries = own.select("key", "id").union(probes).distinct().withColumn("rank", F.lit(0))

    known_texts = []

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = cut_lineage(ids)
        may_hold = membership(ids, "id")
        if not known_texts:
            # the first round asks for every line that shares a key, so texts are read once
            texts = plain.mapInArrow(_texts_of(edits, per_edit, may_hold), "id bigint, text string")
            known_texts.append(cut_lineage(texts.groupBy("id").agg(F.min("text").alias("text"))))
            return known_texts[0]
        return cut_lineage(known_texts[0].where(may_hold_column(may_hold, F.col("id"))).join(ids, "id", "left_semi"))

    def verify(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        met = met.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        met = met.where(F.abs(F.length("x") - F.length("y")) <= edits)
        return met.select("a", "b", "x", "y").mapInArrow(_checked(edits, per_edit), "a bigint, b bigint")

    def keys_of(texts: DataFrame, fine: bool) -> DataFrame:
        entry = "key bigint, id bigint"
        own = cut_lineage(texts.mapInArrow(_combined_entries(edits, per_edit, fine), entry).distinct())
        others = texts.mapInArrow(_combined_entries(edits, per_edit, fine, membership(own)), entry).distinct()
        return own.withColumn("own", F.lit(True)).union(others.withColumn("own", F.lit(False)))

    def finer(ids: DataFrame) -> DataFrame:
        texts = texts_of(ids)
        coarse = cut_lineage(keys_of(texts, False))
        crowd = coarse.groupBy("key").agg((F.count("*") > CROWD).alias("crowded"))
        coarse = cut_lineage(coarse.join(crowd, "key"))
        # two lines that link meet in a key of few lines, or both stand in a crowded one
        crowded = cut_lineage(coarse.where("crowded").select("id").distinct())
        fine = keys_of(cut_lineage(texts.join(crowded, "id", "left_semi")), True)
        return coarse.where("NOT crowded").drop("crowded").union(fine)

    if edits <= FINER_EDITS:
        linked = link_groups(entries, verify, finer=finer, possible="x.own OR y.own")
    else:
        linked = link_groups(entries, verify)
    known = firsts.join(linked, "id", "left").select(
        "id", "second", "first", "times", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("tied")
    )
    # only components of several lines need a first line of their own
    heads = known.where("tied").groupBy("root").agg(F.min("first").alias("head"))
    known = known.join(heads, "root", "left").select("id", "second", "first", F.coalesce("head", "first").alias("head"))
    # a line that stands once and links with nothing stays
    known = cut_lineage(known.where("times > 1 OR tied").select("id", "second", "first", "head"))
    some = rows.select("id", "second", "doc", "line").where(may_hold_column(membership(known, "id"), F.col("id")))
    judged = some.join(known, ["id", "second"])
    here = F.struct("doc", "line")
    return judged.where(here != F.col("head")).select("doc", "line", (here == F.col("first")).alias("near"))


def _without():
    @F.arrow_udf("string")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        """The lines of each text whose numbers are not listed."""
        kept = []
        for text, numbers in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            drop = set(numbers)
            kept.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
        return pa.array(kept, pa.string())

    # else a filter on its result would be pushed below it, and every text cut twice in two workers
    return without.asNondeterministic()


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits: int = EDITS,
    per_edit: int = CHARS_PER_EDIT,
    into: str = "lines",
) -> DataFrame:
    """All rows and columns of `docs` with a struct `into`: text (the lines that stay),
    n_lines, n_removed and n_near.

    A null text counts as empty and has no lines.  See `repeated_lines` for what repeats.
    """
    repeated = repeated_lines(docs, id_col, text_col, edits, per_edit).distinct()
    gone = cut_lineage(
        repeated.groupBy(F.col("doc").alias("id")).agg(
            F.collect_set("line").alias("gone"), F.count_if("near").alias("near")
        )
    )
    holds = membership(gone.select(F.xxhash64("id").alias("key")))
    rows = docs.select(boxed(docs), F.col(id_col).cast("bigint").alias("id"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    # most texts need no shuffle: the filter says which documents surely lose no line
    maybe = may_hold_column(holds, F.xxhash64("id"))
    sure = rows.where(~maybe).select("row", text.alias("text"), F.lit(0).alias("n_removed"), F.lit(0).alias("near"))
    # the documents that lose lines grow with the input, so their table is never broadcast
    some = rows.where(maybe).join(by_merge(gone), "id", "left")
    some = some.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(_without()(text, F.coalesce("gone", F.array().cast("array<bigint>")))).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.coalesce("near", F.lit(0)).alias("near"),
    )
    whole = sure.union(some)
    whole_text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    total = F.when(whole_text == "", 0).otherwise(F.length(whole_text) - F.length(F.replace(whole_text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    info = F.struct(
        "text",
        total.alias("n_lines"),
        F.greatest(F.col("n_removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.col("near").cast("bigint").alias("n_near"),
    )
    return unboxed(whole, docs.columns, **{into: info})
