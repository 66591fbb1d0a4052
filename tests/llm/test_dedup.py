"""Near-duplicates of documents, lines, bytes and vectors against their plain definitions."""

import random

import brute
import numpy as np
import pytest

from attestry.llm import lines as L
from attestry.llm.covertree import near_vectors
from attestry.llm.graph import components, link_groups
from attestry.llm.lines import dedup_lines, within_edits
from attestry.llm.near_dedup import drop_near_duplicates, least_shared, near_duplicates
from attestry.llm.suffixes import equal_strings, remove_repeats

DOCS = "doc_id bigint, text string, lines string, cut int, `row` int, n int, `key` string"


def corpus(seed: int, n: int = 60) -> dict:
    """Texts with exact and near copies, shared passages, null, blank and short ones."""
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "ka mo ti rü se lö".split() for b in "na ru lé ska pi 𝄞o tam".split()]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    bases = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(8)]
    out = {}
    for d in range(n):
        text = rnd.choice(bases).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        text = rnd.choice(["{}", "{}", "{}\n" + passage, passage + "\n{}\n" + passage, "{}\t {}"]).replace("{}", " ".join(text))
        out[d * 3] = rnd.choice([text, text, text, text.upper(), None, "", " \n ", "ab cd", " ".join(rnd.choice(words) for _ in range(40))])
    out[1000] = " ".join(rnd.choice(words) for _ in range(30_000))
    out[1001] = out[1000][:100_000]
    return out


def frame(spark, docs, extra=()):
    rows = [(d, t, "x", 1, 2, 3, "k") for d, t in [*docs.items(), *extra]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_sketch_bound():
    assert least_shared(48, 0.75) in range(16, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = corpus(seed)
    want = brute.near_groups(docs)
    got = near_duplicates(frame(spark, docs, [(None, docs[0]), (3, docs[3])])).collect()
    assert len(got) == len(docs) + 2
    for x in got:
        if x.doc_id is None:
            assert x.kept and x.component_id is None
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (*want[x.doc_id], want[x.doc_id][1] == x.doc_id)
    left = drop_near_duplicates(frame(spark, docs, [(3, docs[3])]))
    assert left.columns == frame(spark, {}).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d in docs if want[d][1] == d)


def test_near_copies_of_one_text(spark):
    """A group whose members mostly do not link with each other but with their source."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    docs = {0: " ".join(f"x{k}" for k in range(150)), 7: " ".join(base)}
    for d in range(10, 90):
        text = list(base)
        for _ in range(rnd.randint(1, 9)):
            text[rnd.randrange(150)] = f"n{rnd.randrange(400)}"
        docs[d] = " ".join(text)
    want = brute.near_groups(docs)
    got = near_duplicates(frame(spark, docs)).collect()
    assert {x.doc_id: x.component_id for x in got} == {d: c for d, (_, c) in want.items()}
    assert len({c for _, c in want.values()}) > 5


def test_links_by_groups(spark):
    """Every link across the members of a key is found, whatever meets first."""
    rnd = random.Random(9)
    keys = [(k, i) for k in range(12) for i in rnd.sample(range(40), rnd.randint(1, 14))]
    good = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)}
    met = {(a, b) for a, b in good if any((k, a) in keys and (k, b) in keys for k in range(12))}
    groups = brute.Groups(range(40))
    for a, b in met:
        groups.join(a, b)
    links = spark.createDataFrame(sorted(good), "a bigint, b bigint")
    entries = spark.createDataFrame([(k, i, i % 3) for k, i in keys], "key bigint, id bigint, rank int")
    got = {r.id: r.root for r in link_groups(entries, lambda p: p.join(links, ["a", "b"]), 1).collect()}
    assert got == {x: groups.root(x) for x in range(40) if x in got}
    assert {x for pair in met for x in pair} == set(got)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 64)] + [(100, 99), (5, 5)], "a bigint, b bigint")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(65), 0), 99: 99, 100: 99}


def test_within_edits():
    rnd = random.Random(5)
    left, right, most = [], [], []
    for _ in range(200):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "𝄞"])
        left.append(a)
        right.append("".join(b))
        most.append(rnd.randint(0, 4))
    want = [brute.edit_distance(a, b) <= e for a, b, e in zip(left, right, most, strict=True)]
    assert within_edits(left, right, np.array(most)).tolist() == want


def test_probes_meet_a_segment():
    rnd = random.Random(6)
    for _ in range(200):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(8, 40)))
        b, tau = list(a), rnd.randint(1, 3)
        for _ in range(tau):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "c"])
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        cut = L.segments(len(b), tau)
        assert any(a[s : s + n] == b[cut[i][0] : cut[i][0] + n] for i, s, n in L.probe_starts(len(a), len(b), tau))


@pytest.mark.parametrize("fine", [False, True])
def test_lines_within_their_edits_share_all_but_small_pieces(fine):
    rnd = random.Random(9)
    for _ in range(25):
        n, most = rnd.choice([3, 20, 41, 64, 65, 90, 130]), rnd.choice([1, 2, 3])
        line = "".join(rnd.choice("abc") for _ in range(n))
        other = list(line)
        for _ in range(rnd.randint(0, most)):
            at = rnd.randrange(len(other) + 1)
            other[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
        other = "".join(other)
        per_edit = 1 if n < 20 else 20
        shorter = min(len(line), len(other))
        if shorter < per_edit or brute.edit_distance(line, other) > min(most, shorter // per_edit):
            continue
        x = L.Lines([line, other], most, per_edit)
        keys = {(k, own): set() for k in (0, 1) for own in (True, False)}
        for lines, key, own in x.combined(fine):
            for k, v in zip(lines.tolist(), key.tolist(), strict=True):
                keys[k, own].add(v)
        ones, others = (keys[k, True] | keys[k, False] for k in (0, 1))
        assert keys[0, True] & others or keys[1, True] & ones, (line, other)


def test_near_copies_that_are_no_links_are_seldom_compared(spark, monkeypatch):
    """Copies of a long line, each with a word of its own somewhere: far from each other, but for a few."""
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    docs = {}
    for d in range(150):
        at = rnd.randrange(20, 380)
        docs[d] = base[:at] + "".join(rnd.choice("klmnop") for _ in range(7)) + base[at:]
    for d in range(150, 160):
        docs[d] = docs[d - 150][:200] + "?" + docs[d - 150][201:]
    seen, link_groups = [], L.link_groups

    def counting(entries, verify, **other):
        def counted(pairs):
            seen.append(pairs.count())
            return verify(pairs)

        return link_groups(entries, counted, **other)

    monkeypatch.setattr(L, "link_groups", counting)
    got = dedup_lines(frame(spark, docs, []), into="found").collect()
    near = {x.doc_id for x in got if x.found.n_near == 1}
    pairs = [(a, b) for b in docs for a in range(b)]
    linked = within_edits([docs[a] for a, _ in pairs], [docs[b] for _, b in pairs], np.full(len(pairs), 2))
    assert near == {b for (_, b), yes in zip(pairs, linked.tolist(), strict=True) if yes} >= set(range(150, 160))
    # every pair shares a segment; the last step once compared nearly half of them
    assert len(seen) == 3 and seen[-1] < 150 * 149 / 2 / 5


def test_lines_that_share_segments_meet_by_three_at_once():
    """Every pair within its edits has a key in common that is one side's own."""
    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.choice([20, 21, 39, 40, 41, 47, 90])
        line = "".join(rnd.choice("ab") if rnd.random() < 0.5 else rnd.choice("cdefgh") for _ in range(n))
        other = list(line)
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(other))
            other[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
        other = "".join(other)
        shorter = min(len(line), len(other))
        if shorter < 20 or brute.edit_distance(line, other) > min(2, shorter // 20):
            continue
        x = L.Lines([line, other], 2, 20)
        keys = {(k, own): set() for k in (0, 1) for own in (True, False)}
        for lines, key, own in x.combined():
            for k, v in zip(lines.tolist(), key.tolist(), strict=True):
                keys[k, own].add(v)
        ones, others = (keys[k, True] | keys[k, False] for k in (0, 1))
        assert keys[0, True] & others or keys[1, True] & ones
        assert L.may_link([line], [other], np.array([min(2, shorter // 20)])).all()


def test_lines_of_a_hot_segment(spark):
    """Many different lines with a long common start; a few of them within their edits."""
    rnd = random.Random(3)
    start = "the quick brown fox jumps over it "
    docs = {d: start + "".join(rnd.choice("abcdefgh") for _ in range(34)) for d in range(60)}
    for d in range(60, 75):
        docs[d] = docs[d - 60][:-2] + "zz"
    docs |= {d: docs[60][:10] + "?" + docs[60][11:] for d in (75, 76)}
    want = brute.kept_lines(docs)
    got = dedup_lines(frame(spark, docs, []), into="found").collect()
    assert {x.doc_id: (x.found.text, x.found.n_removed, x.found.n_near) for x in got} == want
    assert sum(x[2] for x in want.values()) >= 2


def test_lines(spark):
    rnd = random.Random(3)
    sizes = [10, 19, 20, 21, 39, 40, 41, 60, 80]
    bases = ["".join(rnd.choice("ab c") for _ in range(rnd.choice(sizes))).strip() for _ in range(40)]
    docs = {}
    for d in range(50):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                k = rnd.randrange(len(line) + 1)
                line[k : k + rnd.randint(0, 1)] = rnd.choice(["", "é", "\U0001f600"])
            lines.append(rnd.choice(["", " "]) + "".join(line))
        docs[d] = rnd.choice(["\n".join(lines), "\n".join(lines), None])
    want = brute.kept_lines(docs)
    got = dedup_lines(frame(spark, docs, [(None, docs[0]), (900, "")]), into="found").collect()
    assert sum(x[2] for x in want.values()) > 5
    for x in got:
        assert (x.lines, x.cut, x.key) == ("x", 1, "k")
        if x.doc_id in want:
            assert (x.found.text, x.found.n_removed, x.found.n_near) == want[x.doc_id], x.doc_id
        else:
            assert x.found.n_removed == 0
    assert len(got) == len(docs) + 2
    # a column of the result's name is replaced
    assert dedup_lines(frame(spark, {0: "a"})).columns == [*[c for c in frame(spark, {}).columns if c != "lines"], "lines"]


def test_equal_strings():
    rnd = np.random.default_rng(3)
    raw = np.concatenate([rnd.integers(97, 99, 300), np.full(200, 97), rnd.integers(97, 99, 40)]).astype(np.uint8)
    raw = np.concatenate([raw, raw[50:260]])
    for length in (8, 24, 30, 100):
        starts = rnd.permutation(len(raw) - length + 1)
        got = equal_strings(raw, starts, length)
        texts = [raw[s : s + length].tobytes() for s in starts]
        assert [texts[k] for k in got] == texts
        assert len(set(got.tolist())) == len(set(texts))


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, hot):
    docs = corpus(5, 40)
    docs[2000] = "ab" * 400
    docs[2001] = "x" + "ab" * 120 + "é" * 90
    want = brute.cut_repeats(docs, 60)
    got = remove_repeats(frame(spark, docs, [(3, docs[3])]), length=60, gram=20, hot_places=hot, into="out").collect()
    import hashlib

    assert len(got) == len(docs) + 1
    for x in got:
        spans = [(s.lo, s.hi) for s in x.out.spans]
        assert (x.out.n_bytes, spans, hashlib.sha256(x.out.kept).hexdigest()) == want[x.doc_id], x.doc_id
        assert (x.cut, x.row) == (1, 2)


def test_vectors(spark):
    rnd = np.random.default_rng(8)
    rows = {}
    for k in range(150):
        v = rnd.normal(size=6)
        rows[k] = v.tolist()
        if k % 3 == 0:
            rows[200 + k] = (v * rnd.choice([1.0, 2.0, 1e200]) + rnd.normal(size=6) * rnd.choice([0, 0.1, 0.2])).tolist()
    rows |= {500: None, 501: [], 502: [0.0] * 6, 503: [1.0, None, 0.0, 0.0, 0.0, 0.0], 504: [float("nan")] * 6}
    rows |= {505: [float("inf")] * 6, 506: [1.0, 2.0], 507: [2.0, 4.0], 508: rows[3], 509: rows[3], 510: rows[203] if 203 in rows else rows[3]}
    want = brute.near_vectors(rows)
    table = spark.createDataFrame([(k, v, 1) for k, v in rows.items()] + [(3, rows[3], 2), (None, rows[3], 2)], "vec_id bigint, embedding array<double>, id int")
    for block in (2048, 16):
        got = near_vectors(table, block=block).collect()
        assert len(got) == len(rows) + 2
        for x in got:
            if x.vec_id is not None:
                assert (x.n_links, x.component_id) == want[x.vec_id], x
                assert x.kept == (x.vec_id == x.component_id)


def test_empty_tables(spark):
    none = frame(spark, {})
    assert near_duplicates(none).count() == 0
    assert dedup_lines(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
