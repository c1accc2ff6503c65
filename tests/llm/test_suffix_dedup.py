import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import plexor.llm.suffix_dedup as module
from plexor.llm.suffix_dedup import suffix_dedup
from plexor.llm.suffixes import common_prefixes, sorted_directly, suffix_order, type_b, words_at

KIND = "doc_id long, text string, n_bytes string, raw int, sha string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 3) for i, t in rows], KIND)


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            if i is not None:
                w = data[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if i is not None and first[data[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + gone[:1].sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(map(str, out))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé日") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (3, 9, 12, 30, 60)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(3)):
            text += rng.choice(["", " ", "\n"]) + rng.choice(passages) + " " + words(rng, rng.randrange(5))
        rows.append((rng.randrange(1000), text))
    near = words(rng, 80).split()
    for i in range(25):
        copy = list(near)
        copy[rng.randrange(80)] = "edit"
        rows.append((2000 - i, " ".join(copy)))
    rows += [(7, "x" * 49), (8, "x" * 49), (9, "y" * 50), (10, "y" * 50), (11, "z" * 400), (12, "z" * 300 + "q"), (13, "ab" * 200), (14, "ba" * 150)]
    rows += [(20, None), (21, ""), (22, None), (None, rows[0][1]), (None, "y" * 60), (5, passages[4]), (5, passages[4]), (5, passages[4] + passages[3]), (40, words(rng, 3000)), (41, words(rng, 20))]
    rows.append((42, rows[-2][1][500:9000] + "!"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part, hot", [(8 << 20, 20_000), (2_000, 20_000), (2_000, 3)])
def test_as_by_hand(spark, part, hot, monkeypatch):
    monkeypatch.setattr(module, "ANCHORS_OF", 1)
    monkeypatch.setattr(module, "AROUND_OF", 1)
    rows = corpus(part + hot)
    got = suffix_dedup(spark, table(spark, rows), part=part, hot=hot, kept=True).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))) for r in got) == brute(rows)


def test_shorter_strings_and_no_rows(spark):
    rows = corpus(5)
    got = suffix_dedup(spark, table(spark, rows), length=40, part=3_000).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(str(tuple(x)) for x in map(lambda s: eval(s)[:5], brute(rows, 40)))
    assert suffix_dedup(spark, table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup(spark, table(spark, []), length=20)


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"abc\x00", b"ab\xff", bytes(range(256))])
def test_suffixes_are_in_order_and_only_small_ones_sorted(alphabet, monkeypatch):
    import plexor.llm.suffixes as module

    sorted_ones = []
    monkeypatch.setattr(module, "sorted_directly", lambda w, at: (sorted_ones.append(at), sorted_directly(w, at))[1])
    rng = random.Random(len(alphabet))
    for _ in range(60):
        s = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))
        s += s[: len(s) // 2] * rng.randrange(3)
        data, n = np.frombuffer(s, np.uint8), len(s)
        wanted = np.array([rng.random() < 0.7 for _ in range(n)])
        order = suffix_order(data, wanted)
        assert sorted(order) == list(np.flatnonzero(wanted))
        padded = [s[i : i + 50].ljust(50, b"\0") for i in order]
        assert padded == sorted(padded)
        small = [i for i in range(n) if s[i:] < s[i + 1 :]]
        assert list(np.flatnonzero(type_b(data))) == small
        lcp = common_prefixes(words_at(data), order, 50)
        assert list(lcp[1:]) == [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(padded, padded[1:])]
    assert all(set(at) <= set(range(1000)) for at in sorted_ones)


def test_what_is_sorted_directly_is_of_type_b_alone(monkeypatch):
    import plexor.llm.suffixes as module

    seen = []
    monkeypatch.setattr(module, "sorted_directly", lambda w, at: (seen.append(at), sorted_directly(w, at))[1])
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 20, np.uint8)
    order = suffix_order(data, np.ones(len(data), bool))
    assert len(order) == len(data)
    assert type_b(data)[seen[0]].all() and len(seen[0]) == type_b(data).sum() < 0.6 * len(data)


def test_groups_of_windows_count_documents_not_places(spark):
    """A passage that repeats within one document alone stays."""
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(1, passage + " " + passage), (2, words(rng, 50))]
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup(spark, table(spark, rows)).collect()} == {(1, 0), (2, 0)}
    by = defaultdict(int)
    for r in suffix_dedup(spark, table(spark, [*rows, (3, "new " + passage)])).collect():
        by[r.doc_id] = r.n_removed
    assert by[1] == by[2] == 0 and by[3] >= len(passage.encode())
