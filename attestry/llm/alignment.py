"""Which tokens of one tokenizer stand where another's do, and how usual that is.

Both tokenizers cut a text at every space that follows a visible character (`_walls`), so a text's
tokens are those of its segments, and a segment is encoded once for all its places in a block.
Equal segments of a block are known by a 64-bit hash.

Scores go through an inverted index.  Documents are dealt into blocks of about BLOCK_BYTES; for
every pair of an A and a B id a block has one posting: a compressed bitmap of the documents that
hold the pair linked (the words of 64 documents that are not zero, with their places), and the
bits of its multiplicity in each document as planes over the same words.  Slices of a block are
merged by OR where they meet.  Bits counted over all blocks are a pair's documents; the highest
of an A id follows from that; then each posting takes its pair's figures back to its block, where
planes say how often they count for which document.  A pair has one posting in a block, however
often it occurs, so no pair is hot: its share of all postings is at most one by the number of
different pairs in a block.

The texts are read once; a block is bounded by bytes, so memory does not grow with the corpus.
The index grows with it and is only ever a table.

Defined results: texts that are null, empty, or not given back by the tokens of both have no
tokens; every row is a document of its own, repeated ids and rows too; ties for an A id's highest
count are all best; an empty table gives no rows.  A very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches
from attestry.llm.hashing import byte_table, row_slices, run_hashes, text_buffer
from attestry.session import cut_lineage

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECE_BPE = f"{TOKENIZERS}/piece_bpe_32k.model"
BLOCK_BYTES = 1 << 21
CHUNK = 1 << 12  # bytes of segments that are encoded in one go
MARK = "▁"  # the piece model's space
PAIR = 32  # bits of an id in a pair


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes are
    themselves, the others follow from 256 on in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes and digits of every id."""

    def __init__(self, encode, spelled: list[bytes]):
        self.encode = encode
        self.sizes = np.array([len(t) for t in spelled], np.int64)
        self._places = np.concatenate(([0], np.cumsum(self.sizes)))
        self._bytes = np.frombuffer(b"".join(spelled), np.uint8)
        digits = [str(i).encode() for i in range(len(spelled))]
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self.digits_at = np.concatenate(([0], np.cumsum(self.n_digits)))[:-1]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def spells(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        sizes = self.sizes[ids]
        return int(sizes.sum()) == len(raw) and bool(np.array_equal(_gather(self._bytes, self._places[ids], sizes), raw))

    def tokens(self, chunks: list[tuple[int, int]], raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all segments, how many each has, and which segments their tokens give back.

        `chunks` are ranges of segments that are encoded together.
        """
        whole = raw.tobytes()
        found = self.encode([whole[bounds[i] : bounds[j]] for i, j in chunks])
        ids, counts = [], np.zeros(len(bounds) - 1, np.int64)
        good = np.ones(len(counts), bool)
        for (i, j), own in zip(chunks, found, strict=True):
            ends = np.cumsum(self.sizes[own])
            inner = bounds[i + 1 : j + 1] - bounds[i]
            at = np.searchsorted(ends, inner)
            if self.spells(own, raw[bounds[i] : bounds[j]]) and np.array_equal(ends[at], inner):
                ids.append(own)
                counts[i:j] = np.diff(at, prepend=-1)
                continue
            # some segment here isn't given back: one by one
            for k in range(i, j):
                own = self.encode([whole[bounds[k] : bounds[k + 1]]])[0]
                good[k] = self.spells(own, raw[bounds[k] : bounds[k + 1]])
                if good[k]:
                    ids.append(own)
                    counts[k] = len(own)
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), counts, good


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + sizes[i]], one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Aligner:
    """Both tokenizers."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        # a task has one core; the library would start a thread for each
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_bpe)
        a.encode_special_tokens = True
        letters = _byte_letters()
        spelled_a = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            # a special token's own letters; it never occurs
            spelled_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

        b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        spelled_b = [
            bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(MARK, " ").encode() for i, piece in enumerate(pieces)
        ]
        space = b.piece_to_id(MARK)

        def encode_a(texts: list[bytes]) -> list[np.ndarray]:
            return [np.array(x.ids, np.int64) for x in a.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

        def encode_b(texts: list[bytes]) -> list[np.ndarray]:
            # the model puts the space before a text itself, but says nothing of an empty one
            found = b.encode([t[1:].decode() for t in texts], num_threads=1)
            return [np.array(x if len(t) > 1 else [space], np.int64) for t, x in zip(texts, found, strict=True)]

        self.a, self.b = Side(encode_a, spelled_a), Side(encode_b, spelled_b)


class Aligned:
    """Different segments, encoded and aligned: figures, groups as text, and links of each."""

    def __init__(self, aligner: Aligner, raw: np.ndarray, bounds: np.ndarray, walled: int):
        """Segment i is raw[bounds[i]:bounds[i + 1]]; the first `walled` ones end in a wall."""
        n = len(bounds) - 1
        cuts = np.unique(np.searchsorted(bounds[: walled + 1], np.arange(0, bounds[walled] + CHUNK, CHUNK)).clip(0, walled)).tolist()
        chunks = [*itertools.pairwise(cuts), *((k, k + 1) for k in range(walled, n))]
        ids_a, n_a, good_a = aligner.a.tokens(chunks, raw, bounds)
        ids_b, n_b, good_b = aligner.b.tokens(chunks, raw, bounds)
        self.good = good_a & good_b
        ids_a, ids_b = ids_a[np.repeat(self.good, n_a)], ids_b[np.repeat(self.good, n_b)]
        self.n_a, self.n_b = n_a * self.good, n_b * self.good
        of_a, of_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        # segments that are not good take no room: all tokens on one line
        ends_a, ends_b = np.cumsum(aligner.a.sizes[ids_a]), np.cumsum(aligner.b.sizes[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        self.n_groups = np.bincount(of_a[np.searchsorted(ends_a, both)], minlength=n)

        # the tokens of A and B of a group one after the other, each with the mark that follows it
        group, side = np.concatenate((group_a, group_b)), np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side = group[order], side[order]
        digits = np.concatenate((aligner.a.digits, aligner.b.digits))
        at = np.concatenate((aligner.a.digits_at[ids_a], aligner.b.digits_at[ids_b] + len(aligner.a.digits)))[order]
        sizes = np.concatenate((aligner.a.n_digits[ids_a], aligner.b.n_digits[ids_b]))[order]
        marks = np.full(len(order), ord(","), np.uint8)
        if len(order):
            last = np.concatenate((group[1:] != group[:-1], [True]))
            marks[np.concatenate((side[1:] != side[:-1], [False]))] = ord("|")
            marks[last] = ord(";")
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        is_mark = np.zeros(len(text), bool)
        is_mark[ends - 1] = True
        text[is_mark] = marks
        text[~is_mark] = _gather(digits, at, sizes)
        total = np.bincount(np.concatenate((of_a, of_b))[order], weights=sizes + 1, minlength=n).astype(np.int64)
        cut = np.concatenate(([0], np.cumsum(total))).tolist()
        whole = text.tobytes()
        self.groups = [whole[i:j] for i, j in itertools.pairwise(cut)]

        # token i of A meets those of B that end after its start and start before its end
        first = np.searchsorted(ends_b, ends_a - aligner.a.sizes[ids_a], "right")
        sizes = np.searchsorted(ends_b, ends_a, "left") + 1 - first
        self.pairs = (np.repeat(ids_a, sizes) << PAIR) | _gather(ids_b, first, sizes)
        self.n_links = np.bincount(of_a, weights=sizes, minlength=n).astype(np.int64)


@lru_cache(maxsize=2)
def _aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One for each worker."""
    return Aligner(byte_bpe, piece_bpe)


# bytes that end a word for both tokenizers: visible ASCII; of two-byte letters the second byte,
# known by a first byte from 0xC3 on, as no white space is written with one
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def _walls(raw: np.ndarray) -> np.ndarray:
    """Which bytes surely end a word."""
    walls = _VISIBLE[raw]
    walls[1:] |= _SECOND[raw[1:]] & _LEAD[raw[:-1]]
    return walls


def segment_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where segments start in rows that each start with a space: at the row's own start and
    at every space after a byte that surely ends a word."""
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.zeros(len(raw), bool)
    starts[1:] = (raw[1:] == 0x20) & _walls(raw)[:-1]
    starts[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(starts)


def _spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each row that isn't empty."""
    sizes = np.diff(off)
    bounds = np.concatenate(([0], np.cumsum(sizes + (sizes > 0))))
    out = np.full(bounds[-1], 0x20, np.uint8)
    keep = np.ones(bounds[-1], bool)
    keep[bounds[:-1][sizes > 0]] = False
    out[keep] = raw
    return out, bounds


def _postings(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> pa.Array:
    """One list element for each pair: its documents as words of 64 bits, and their planes.

    `pairs`, `docs`, `times` are entries that may name a pair and document several times.
    """
    order = np.lexsort((docs, pairs))
    pairs, docs, times = pairs[order], docs[order], times[order]
    new = np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (docs[1:] != docs[:-1])))
    at = np.flatnonzero(new)
    pairs, docs, times = pairs[at], docs[at], np.add.reduceat(times, at)
    word = docs >> 6
    bit = np.uint64(1) << (docs & 63).astype(np.uint64)
    new = np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (word[1:] != word[:-1])))
    at = np.flatnonzero(new)
    n_planes = int(times.max()).bit_length()
    planes = [np.bitwise_or.reduceat(np.where((times >> k) & 1, bit, np.uint64(0)), at) for k in range(n_planes)]
    bits = np.bitwise_or.reduceat(bit, at)
    pairs, word = pairs[at], word[at]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    bounds = np.concatenate((first, [len(pairs)]))
    count = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    # planes above a pair's highest multiplicity are left out: plane by plane, only words with bits
    plane_of = np.concatenate([np.full(len(bits), k) for k in range(n_planes)])
    values, owner = np.concatenate(planes), np.tile(np.repeat(np.arange(len(first)), np.diff(bounds)), n_planes)
    places = np.tile(word, n_planes)
    full = np.flatnonzero(values)
    full = full[np.argsort(owner[full], kind="stable")]
    sizes = np.concatenate(([0], np.cumsum(np.bincount(owner[full], minlength=len(first))))).astype(np.int32)
    as_list = lambda flat, kind: pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, kind))
    return pa.StructArray.from_arrays(
        [
            pa.array(pairs[first]),
            pa.array(count),
            as_list(((plane_of << 24) | places)[full].astype(np.int32), pa.int32()),
            as_list(values[full].view(np.int64), pa.int64()),
        ],
        names=["pair", "n_docs", "places", "planes"],
    )


POSTING = "struct<pair:bigint,n_docs:bigint,places:array<int>,planes:array<bigint>>"
DIGEST = "row int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _blocks(byte_bpe: str, piece_bpe: str, keys: list[str], block_bytes: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            aligner = aligner or _aligner(byte_bpe, piece_bpe)
            raw, off = text_buffer(batch["text"])
            for lo, hi in row_slices(np.diff(off), block_bytes):
                digests, postings = _index(aligner, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ids = [batch[k].slice(lo, hi - lo) for k in keys]
                docs = pa.StructArray.from_arrays([*ids, *digests.values()], names=[*keys, *digests])
                yield pa.record_batch(
                    [
                        pa.array([(part << 32) | block], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                        pa.ListArray.from_arrays(pa.array([0, len(postings)], pa.int32()), postings),
                    ],
                    ["block", "docs", "postings"],
                )
                block += 1

    return index


def _index(aligner: Aligner, raw: np.ndarray, off: np.ndarray) -> tuple[dict[str, pa.Array], pa.Array]:
    """The digests of a block's rows and its postings."""
    raw, off = _spaced(raw, off)
    starts = segment_starts(raw, off)
    ends = np.concatenate((starts[1:], [len(raw)]))[: len(starts)]
    hashes = run_hashes(byte_table(False)[raw], starts, ends)
    _, where, kind = np.unique(hashes, return_index=True, return_inverse=True)
    # those that end in a wall first: they can be encoded in one go
    ends_in_wall = _walls(raw)[ends[where] - 1] if len(where) else np.zeros(0, bool)
    order = np.argsort(~ends_in_wall, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    where, kind = where[order], place[kind]
    sizes = ends[where] - starts[where]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    known = Aligned(aligner, _gather(raw, starts[where], sizes), bounds, int(ends_in_wall.sum()))

    n = len(off) - 1
    first = np.searchsorted(starts, off)
    row = np.repeat(np.arange(n), np.diff(first))
    bad = np.bincount(row[~known.good[kind]], minlength=n) > 0
    kept = ~bad[row]
    digests: dict[str, pa.Array] = {"row": pa.array(np.arange(n, dtype=np.int32))}
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        sums = np.bincount(row[kept], weights=getattr(known, name)[kind[kept]], minlength=n)
        digests[name] = pa.array(sums.astype(np.int64))
    listed, rows = kind.tolist(), first.tolist()
    texts = (b"" if bad[r] else b"".join([known.groups[k] for k in listed[rows[r] : rows[r + 1]]])[:-1] for r in range(n))
    digests["groups_sha256"] = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
    if not kept.any():
        return digests, _no_postings()
    held, often = np.unique(row[kept] * len(where) + kind[kept], return_counts=True)
    docs, kinds = np.divmod(held, len(where))
    each = known.n_links[kinds]
    pairs = _gather(known.pairs, (np.cumsum(known.n_links) - known.n_links)[kinds], each)
    return digests, _postings(pairs, np.repeat(docs, each), np.repeat(often, each))


def _no_postings() -> pa.Array:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.StructArray.from_arrays([pa.array([], k) for k in kinds], names=["pair", "n_docs", "places", "planes"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one block: for each of its rows the best links and the sum of counts."""
    best, total, block = np.zeros(64, np.int64), np.zeros(64, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch["block"][0]
        lists = batch["places"]
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        words = np.ascontiguousarray(batch["planes"].flatten().to_numpy(zero_copy_only=False))
        shown = np.unpackbits(words.view(np.uint8), bitorder="little")
        word, bit = np.divmod(np.flatnonzero(shown), 64)
        doc = (place[word] & ((1 << 24) - 1)) * 64 + bit
        often = np.int64(1) << (place[word] >> 24)
        top = int(doc.max()) + 1 if len(doc) else 0
        if top > len(best):
            best, total = (np.concatenate((x, np.zeros(max(top, 2 * len(x)) - len(x), np.int64))) for x in (best, total))
        count = batch["count"].to_numpy()[owner[word]]
        leads = batch["best"].to_numpy(zero_copy_only=False)[owner[word]]
        np.add.at(total, doc, often * count)
        np.add.at(best, doc[leads], often[leads])
    rows = np.flatnonzero(total)
    if block is not None:
        yield pa.record_batch(
            [pa.array([block.as_py()] * len(rows), pa.int64()), pa.array(rows.astype(np.int32)), pa.array(best[rows]), pa.array(total[rows])],
            ["block", "row", "n_best", "count_sum"],
        )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each pair is linked, and whether that is its A id's highest."""
    postings = blocks.select(F.explode("postings").alias("p")).select("p.pair", "p.n_docs")
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("count")).withColumn("a", F.shiftright("pair", PAIR))
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    Both files must be readable under their paths on every executor.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shape = f"block bigint, docs array<struct<key:{kind},{DIGEST.replace(' ', ':').replace(',:', ',')}>>, postings array<{POSTING}>"
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    blocks = cut_lineage(texts.mapInArrow(_blocks(byte_bpe, piece_bpe, ["key"], block_bytes), shape))

    postings = blocks.select("block", F.explode("postings").alias("p")).select("block", "p.pair", "p.places", "p.planes")
    scored = postings.join(pair_counts(blocks), "pair").select("block", "places", "planes", "count", "best")
    back = scored.groupBy("block").applyInArrow(_scores, "block bigint, row int, n_best bigint, count_sum bigint")

    digests = blocks.select("block", F.explode("docs").alias("d")).select("block", "d.*")
    joined = digests.join(back, ["block", "row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
