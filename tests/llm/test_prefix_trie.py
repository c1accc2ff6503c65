import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

import plexor.llm.store as module
from plexor.llm.prefix_trie import NODE, prefix_trie, rolled_up
from plexor.llm.store import Store

KIND = "conv_id long, turn long, role string, text string, depth int, d1 string, n_convs long, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 7, 2) for r in rows], KIND)


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    again = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in again.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def under(k):
        todo = [k]
        while todo:
            x = todo.pop()
            todo += children[x]
            yield x

    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(again[c]) == len(k))))
        sub = list(under(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), sum(not children[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def got(spark, rows):
    return sorted(str(tuple(r)) for r in prefix_trie(spark, table(spark, rows)).collect())


def test_as_by_hand(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", None, "é"]), rng.choice(["a", "b", "", None, "日本"])) for c in [*range(-3, 130), 205, 207, 301] for t in range(rng.randrange(1, 8))]
    rows += [(5, None, "system", "s"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (None, 0, "user", "no id"), (41, 9, "user", "long " * 30_000)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    few = [c for c in range(201, 400) if zlib.crc32(str(c).encode()) % 6 > 2 and c > 300][:5]  # conversation 300 is absent
    rows = [(c, 0, "user", "gone") for c in few] + [(777, 0, "user", "x")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_a_long_conversation_in_few_rounds_and_a_hot_first_turn(spark, monkeypatch):
    rows = [(0, t, "user", f"t{t}") for t in range(70)] + [(c, 0, "user", "same") for c in range(1000, 1060)] + [(c, 1, "user", str(c % 7)) for c in range(1000, 1060)]
    rounds = []
    put = Store.put
    monkeypatch.setattr(Store, "put", lambda self, df, name, **o: (rounds.append(name), put(self, df, name, **o))[1])
    assert got(spark, rows) == brute(rows)
    assert sum(n.startswith("pointers") for n in rounds) == 7  # 70 turns, 2^7 > 70


@pytest.mark.parametrize("hot", [1, 4096])
def test_sums_reach_every_ancestor(spark, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT", hot)
    rng = random.Random(hot)
    parent = {0: None} | {i: rng.randrange(max(0, i - 3), i) for i in range(1, 60)}
    depth = {0: 0}
    for i in range(1, 60):
        depth[i] = depth[parent[i]] + 1
    nodes = spark.createDataFrame([(i, -i, depth[i], parent[i], None if parent[i] is None else -parent[i], 1) for i in parent], "d1 long, d2 long, depth long, p1 long, p2 long, s long")
    found = {r.d1: r.s for r in rolled_up(Store(spark, "test"), nodes, ["s"]).select(*NODE, "s").collect()}
    want = defaultdict(int)
    for i in parent:
        x = i
        while x is not None:
            want[x] += 1
            x = parent[x]
    assert found == dict(want)
