"""Token alignment, phrase mining and sharding on small inputs, against plain definitions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import Row

from attestry.llm.alignment import BYTE_BPE, MARK, PIECE_BPE, _byte_letters, align_tokens
from attestry.llm.phrases import collocations, frequent_phrases, score_of
from attestry.llm.sharding import interleave, measured, write_shards

ODD = [
    "", " ", "  ", "a ", " a", "a  b", "\n", "a\n b", "a \n b\t\tc ", "don't we'll 'sx", "é è  ü", "日本語 テキスト です", "x  y",
    "a  b", "a b c\u0085 d", "\U0001f600 \U0001f600\U0001f600 z", f"mark {MARK}here ok", "<|endoftext|> <s> </s> <unk>",
    "<0x41> <0x0A>", "\x00 \x01x \x7f y", "12 345 67,8.9", "ﬁ é é", "word " * 300, "!!! ??? ...", "﻿ bom", "\r\n x",
    "ab" * 4000, "a\x1c b\x1f c", "ñ ñ", "ب ب مرحبا بك",
]


# --- token alignment ----------------------------------------------------------------------


def align_by_hand(texts):
    """Both tokenizers on whole texts; every pair of tokens looked at through their ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    letters = _byte_letters()

    def spelled_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode()

    found = []
    for text in texts:
        links, groups, ids = Counter(), [], ([], [])
        if text:
            whole = (" " + text).encode()
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelled = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [spelled_b(i) for i in ids[1]]
            if b"".join(spelled[0]) != whole or b"".join(spelled[1]) != whole:
                ids = ([], [])
        if ids[0]:
            ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
            cuts = sorted(set(ends[0]) & set(ends[1]))
            at = 0
            for cut in cuts:
                sides = [[(i, e) for i, e in zip(ids[k], ends[k], strict=True) if at < e <= cut] for k in (0, 1)]
                groups.append("|".join(",".join(str(i) for i, _ in side) for side in sides))
                at = cut
            starts = [[0, *e[:-1]] for e in ends]
            j0 = 0
            for i, lo, hi in zip(ids[0], starts[0], ends[0], strict=True):
                while ends[1][j0] <= lo:
                    j0 += 1
                j = j0
                while j < len(ids[1]) and starts[1][j] < hi:
                    links[i, ids[1][j]] += 1
                    j += 1
        found.append((len(ids[0]), len(ids[1]), groups, links))
    counts = Counter(pair for *_, links in found for pair in links)
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [
        (
            n_a, n_b, len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == most[p[0]]),
            sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in found
    ]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def mixed_texts(n, seed=5):
    r = random.Random(seed)
    words = ["the", "retitioning", "über", "naïve", "x1", "don't", "--", "…", "日本", "a", "Zürich's", "\n", " ", "  ", "\t"]
    return [r.choice([" ", "", " "]).join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [64, 1 << 21])
def test_alignment_against_whole_texts(spark, block_bytes):
    texts = [None, *ODD, *ODD[:9], *mixed_texts(300)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, block=1, pair="x") for i, t in enumerate(texts)], "doc_id long, text string, block int, pair string")
    got = {r.doc_id: tuple(r[c] for c in FIGURES) for r in align_tokens(docs.repartition(3), block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(align_by_hand(texts)):
        assert got[i] == want, repr(texts[i])[:200]


def test_alignment_of_repeated_rows_null_ids_and_nothing(spark):
    schema = "doc_id long, text string"
    rows = [(1, "one text here"), (1, "one text here"), (None, "one text"), (None, None)]
    got = align_tokens(spark.createDataFrame(rows, schema)).collect()
    want = align_by_hand([t for _, t in rows])
    assert sorted(tuple(r[c] for c in FIGURES) for r in got) == sorted(want)
    assert align_tokens(spark.createDataFrame([], schema)).count() == 0


# --- phrases ------------------------------------------------------------------------------


def phrases_by_hand(rows, support=10, top=2000):
    import re

    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        kept = []
        often = {p: a for p, a in found.items() if a >= support and len(p) > 1}
        for p, a in often.items():
            if any(100 * b >= 50 * a for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((1000000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), found[p[:k]], found[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, le, r, totals[lang], s) for i, (s, a, p, le, r) in enumerate(kept[:top])]
    return sorted(out)


REPORT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def reported(found, **options):
    return sorted(tuple(r[c] for c in REPORT) for r in collocations(found, **options).collect())


def phrase_rows(seed, n=400):
    r = random.Random(seed)
    words = ["The", "of", "ÉTÉ", "été", "new", "york", "a-b", "x", "日", "red", "tape", "İ"]
    glue = [" ", "  ", "\t", " ", ". ", ",", "\n", " ! "]
    rows = [
        ("".join(r.choice(words[: r.randint(2, 12)]) + r.choice(glue) for _ in range(r.randint(0, 40))), r.choice(["en", "und", None, ""]))
        for _ in range(n)
    ]
    return [*rows, *rows[:50], (None, "en"), ("", None), ("one two three " * 20, "solo"), ("z", "one word")]


def test_phrases_against_plain_counting(spark):
    rows = phrase_rows(3)
    docs = spark.createDataFrame([(t, la, 1, "x") for t, la in rows], "text string, lang string, words int, key string").repartition(3)
    want = phrases_by_hand(rows)
    assert len(want) > 50
    assert reported(frequent_phrases(docs)) == want
    # any number of mining shards finds the same phrases
    for shards in (1, 3, 20):
        assert reported(frequent_phrases(docs, shards=shards)) == want
    assert reported(frequent_phrases(docs), top=5) == [x for x in want if x[1] <= 5]


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    import numpy as np

    from attestry.llm import phrases

    text = "; ".join(" ".join(random.Random(i).choices("abcde", k=9)) for i in range(400))
    monkeypatch.setattr(phrases, "SLICE", 100)
    chunks = list(phrases._chunks(pa.array([text])))
    assert len(chunks) > 20 and b"".join(c[2].tobytes() for c in chunks).decode() == text
    total = Counter()
    for _, _, raw, off in chunks:
        for n, at, _ in (w := phrases.Words(raw, off, np.zeros(1, np.uint64), 3)).phrases():
            total.update(w.spelled(at, n).to_pylist())
    whole = Counter()
    for piece in text.split(";"):
        words = piece.split()
        for n in (1, 2, 3):
            whole.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    assert total == whole


def test_no_phrases(spark):
    schema = "text string, lang string"
    assert reported(frequent_phrases(spark.createDataFrame([], schema))) == []
    assert reported(frequent_phrases(spark.createDataFrame([(None, None), ("a b", "en")], schema))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**16 - 1, 10**16 + 7, 10**16 + 9), (3 * 10**15, 3 * 10**15 + 1, 7 * 10**15), (10, 10, 10), (11, 12, 13)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [x[0] for x in df.select(score_of(df.a, df.l, df.r)).collect()]
    assert got == [1000000 * a * a // (le * r) for a, le, r in cases]


# --- shards -------------------------------------------------------------------------------

DOCS = "doc_id long, source string, text string, place string"


def shard_rows(n, seed=1):
    r = random.Random(seed)
    sources = ["hot"] * 10 + ["b"] * 5 + ["c", None, "-", "=", ""]
    return [(i, r.choice(sources), r.choice([None, "", "é" * r.randint(0, 9), "same"]), "x") for i in range(n)]


def shards_by_hand(rows, shards):
    ids = ["" if r[0] is None else str(r[0]) for r in rows]
    draws = [int(hashlib.md5(f"shard{i}".encode()).hexdigest()[:15], 16) for i in ids]
    by_source = defaultdict(list)
    for (doc_id, source, text, _), draw in zip(rows, draws, strict=True):
        said = (text or "").encode()
        by_source[source].append((draw, doc_id is not None, doc_id or 0, zlib.crc32(said), len(said) + 8, doc_id))
    order = []
    for source, members in by_source.items():
        for k, m in enumerate(sorted(members)):
            order.append(((2 * k + 1) / (2 * len(members)), source is not None, source or "", k, m))
    order.sort(key=lambda x: x[:4])
    out, slots = [], Counter()
    for p, (*_, source, _, m) in enumerate(order):
        shard = p * shards // len(order)
        out.append((m[5], m[4], m[3], shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "shards"), [(1000, 24), (1000, 7), (10, 24), (1, 3), (0, 4)])
def test_shards_against_sorting(spark, n, shards):
    rows = shard_rows(n)
    rows += rows[:20] + [(None, "hot", "no id", "x")] * (2 if n > 10 else 0)
    placed = interleave(measured(spark.createDataFrame(rows, DOCS)).withColumnRenamed("place", "own"), shards)
    got = sorted(((r.doc_id, r.content["size"], r.content.text_crc32, r.place.shard, r.place.slot) for r in placed.collect()), key=str)
    assert got == shards_by_hand(rows, shards)
    if n >= 1000:
        per = Counter(r[3] for r in got)
        assert max(per.values()) - min(per.values()) <= 1
        mixture, sizes = Counter(r[1] for r in rows), Counter((r.place.shard, r.source) for r in placed.collect())
        for source, total in mixture.items():
            held = [sizes[s, source] for s in range(shards)]
            assert max(held) - min(held) <= 2 and abs(sum(held) - total) == 0


def test_written_shards(spark, tmp_path):
    rows = shard_rows(300)
    docs = spark.createDataFrame(rows, DOCS)
    write_shards(docs, str(tmp_path / "shards"), shards=5, files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select("doc_id", "source", "text", "place").collect())) == sorted(map(str, docs.collect()))
    for shard in back.select("shard", "slot").groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
        assert shard["max(slot)"] == shard["count(1)"] - 1


def test_sharding_moves_no_text(spark):
    plan = interleave(measured(spark.createDataFrame(shard_rows(5), DOCS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
