import re
from collections import defaultdict

import pytest

import plexor.llm.exact_dedup as exact_dedup_module
from plexor.llm.exact_dedup import build_index, directory, dropped_copies, exact_dedup

KIND = "doc_id long, text string, h string, sha int, link string, row int, chain string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], KIND)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (8, ""), (1, "c"), (1, "c"), (None, "c"), (None, "d"), (2, "é " * 3000), (4, "é\n" * 3000), (6, "A b")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {(i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}


def test_groups_and_keepers(spark):
    got = exact_dedup(spark, table(spark, ROWS)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute(ROWS)
    assert len(got) == len(ROWS)
    assert sum(r.kept for r in got) == 7  # one of each text, one of the repeated rows
    assert [r.kept for r in got if r.doc_id is None].count(True) == 1  # the row that is alone with its text


def test_bytes_decide_where_hashes_collide(spark):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup(spark, table(spark, rows), key_chars=1, capacity=3, slot_bits=4).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute(rows)
    assert sum(r.kept for r in got) == 40


def test_directory_splits_only_overfull_buckets():
    assert directory({0: 10, 1: 10, 8: 1, 15: 1}, 12, 4) == {0: 4, 1: 4, 8: 1, 15: 1}
    assert directory({}, 1, 4) == {}
    assert directory({3: 99}, 5, 2) == {3: 3}  # more bits than slots have


def test_buckets_hold_their_keys_and_split_without_a_limit(spark):
    rows = [(i, f"text {i}") for i in range(600)]
    keys, slots, index = build_index(spark, table(spark, rows), capacity=5, slot_bits=3)
    got = index.collect()
    assert len(got) == 600 and max(r.depth for r in got) > 3
    loads = defaultdict(int)
    for r in got:
        assert r.bucket == (r.h % 2**64) >> (64 - r.depth)
        loads[r.depth, r.bucket] += 1
    assert max(loads.values()) <= 5
    assert {r.slot: r.depth for r in slots.collect()} == {(r.h % 2**64) >> 61: r.depth for r in got}


def test_equal_keys_chain_in_a_bucket_that_cannot_split(spark):
    rows = [(i, f"text {i}") for i in range(60)]
    keys, slots, index = build_index(spark, table(spark, rows), capacity=1, slot_bits=3, key_chars=1)
    chains = defaultdict(list)
    for r in index.collect():
        chains[r.h].append(r.chain)
    assert len(chains) <= 16 and sum(map(len, chains.values())) == 60
    assert all(sorted(c) == list(range(1, len(c) + 1)) or c == [0] for c in chains.values())


def test_rows_are_answered_through_the_directory(spark, monkeypatch):
    """Without a slot's row the rows of its buckets find no entry."""
    rows = [(i, f"text {i % 200}") for i in range(400)]
    assert exact_dedup(spark, table(spark, rows), slot_bits=3).count() == 400
    whole = exact_dedup_module.depths
    monkeypatch.setattr(exact_dedup_module, "depths", lambda *a: whole(*a).where("slot <> 2"))
    assert exact_dedup(spark, table(spark, rows), slot_bits=3).count() < 400


@pytest.mark.parametrize("hot", [1, 10**6])
def test_hot_and_other_entries_answer_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup_module, "HOT", hot)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(spark, table(spark, ROWS)).collect()} == brute(ROWS)


def test_a_null_id_is_no_id(spark):
    """Rows without an id go where a row with one has the text, whatever that id is; of several without, one stays."""
    rows = [(-1, "same text"), (None, "same  text"), (0, "zero"), (None, "zero"), (None, "none"), (None, "none"), (None, "none ")]
    out = dropped_copies(spark, table(spark, rows))
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(-1, "same text"), (0, "zero"), (None, "none"), (None, "none ")]))


def test_kept_documents_keep_their_columns(spark):
    docs = table(spark, ROWS).withColumnRenamed("h", "__id").withColumnRenamed("link", "__sha")
    out = dropped_copies(spark, docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 2), (False, 3), (False, 6), (False, 7), (False, 9), (True, 0)]


def test_empty_table(spark):
    assert exact_dedup(spark, table(spark, [])).count() == 0
    assert dropped_copies(spark, table(spark, [])).count() == 0
