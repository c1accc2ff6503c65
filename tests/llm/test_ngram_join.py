import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexor.llm.ngram_join import first_of_groups, near_duplicates, tail_bits

KIND = "doc_id long, text string, n int, members string, g string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, "", "", 0) for i, t in rows], KIND)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    place = {s: i for i, s in enumerate(frozenset().union(*sets))}
    has = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        has[i, [place[x] for x in s]] = 1
    both = has @ has.T  # every pair of all rows
    any_of = has.sum(axis=1)[:, None] + has.sum(axis=1) - both
    for a, b in zip(*np.nonzero((both > 0) & (100 * both >= 75 * any_of))):
        home[find(int(a))] = find(int(b))
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted((str(name), len(sets[i]), str(least.get(find(i)) if sets[i] else name)) for i, (name, _) in enumerate(rows))


def corpus(seed, families=6, copies=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passages = [[word() for _ in range(60)] for _ in range(3)]
    rows, i = [], 0
    for f in range(families):
        base = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = word()
            rows.append((i := i + 1, rng.choice([" ", "\n", "  "]).join(w)))
    for _ in range(40):  # mostly a passage that many share
        rows.append((i := i + 1, " ".join(rng.choice(passages) + [word() for _ in range(rng.randint(1, 60))])))
    rows += [((i := i + 1), t) for t in ("", None, " \n", "one", "ONE", "two words", "Two  Words", "a b c d", "a b c d e", "İx y z")]
    rows += [(None, "a b c d"), (None, "no id at all"), (i, "İx y z"), rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"small": 2, "pivots": 2})])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    got = near_duplicates(spark, table(spark, rows), **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def quoted(seed, families=12):
    """Pairs of near copies, chains of versions of which each links with the next alone, and last a text that quotes one of each."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, quotes = [], []
    for f in range(families):
        w = [word() for _ in range(120)]
        chain = [list(w)]
        for step in range(1 if f % 2 else 4):
            w = list(w)
            w[10 + 20 * step] = w[12 + 20 * step] = word()
            w[16 + 20 * step] = word()
            chain.append(w)
        texts += chain
        quotes += chain[rng.randrange(len(chain))]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts + [quotes])]
    return rows


@pytest.mark.parametrize("seed, turned, options", [(3, False, {}), (4, True, {}), (5, False, {"small": 2, "pivots": 2})])
def test_a_long_quoting_text_hides_no_link(spark, seed, turned, options):
    rows = quoted(seed)
    got = near_duplicates(spark, table(spark, rows[::-1] if turned else rows), **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = table(spark, [(3, text), (2, text + " end"), (9, "other words here"), (7, None)])
    out = first_of_groups(spark, docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 9]


def test_empty_table_and_bounds(spark):
    assert near_duplicates(spark, table(spark, [])).count() == 0
    assert tail_bits(0.75) >= 64 and tail_bits(0.9) > tail_bits(0.75)
    with pytest.raises(ValueError):
        near_duplicates(spark, table(spark, []), percent=50)


def test_rows_without_an_id_and_repeated_rows_go_with_their_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (4, text + " end"), (4, text + " end"), (None, "some words of their own"), (None, "Some words of their own"), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, __none int, __id int, __raw int")
    out = first_of_groups(spark, docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["4", "8", "8", "None", "None"]
    assert sum((r.text or "").lower().startswith("some") for r in out.collect()) == 1


def grouped(seed, clusters, copies, boilerplate=0):
    """Clusters of near copies, far from each other but for a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared, rows = [word() for _ in range(boilerplate)], []
    for _ in range(clusters):
        base = [word() for _ in range(90)]
        for _ in range(copies):
            w = shared + base
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(shared or ["x"]) if rng.random() < 0.3 else word()
            rows.append((len(rows), " ".join(w)))
    return rows


def counted(spark, monkeypatch, rows, **options):
    import plexor.llm.ngram_join as module

    works = []
    whole = module.RegionJoin.__init__
    monkeypatch.setattr(module.RegionJoin, "__init__", lambda self, *a: (works.append(self), whole(self, *a))[1])
    got = near_duplicates(spark, table(spark, rows), **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    return sum(t.count() for t in works[0].compared)


def test_a_group_of_near_copies_costs_no_pairs_within(spark, monkeypatch):
    """A group three times as large has not nine times the comparisons."""
    small, large = (counted(spark, monkeypatch, grouped(7, 1, n), small=32) for n in (100, 300))
    assert large < 4 * small + 400 and large < 300 * 299 / 8


def test_regions_of_many_clusters_divide(spark, monkeypatch):
    rows = grouped(9, 24, 8, boilerplate=30)
    assert counted(spark, monkeypatch, rows, small=16, pivots=6) < len(rows) * (len(rows) - 1) / 6


def nearly(seed, groups, shared=164, words=200):
    """Groups of three near copies; texts of different groups share most of their words, but too few to link."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    start, rows = [word() for _ in range(shared)], []
    for _ in range(groups):
        own = [word() for _ in range(words - shared)]
        rows += [(len(rows) + k, " ".join(start + own[: len(own) - k] + [word() for _ in range(k)])) for k in range(3)]
    return rows


def test_a_group_that_nearly_links_costs_comparisons_in_proportion(spark, monkeypatch):
    """240, 480 and 960 texts that share 164 of 200 words, three by three near copies."""
    costs = [counted(spark, monkeypatch, nearly(11, n)) for n in (80, 160, 320)]
    assert all(cost <= 4 * 3 * n for cost, n in zip(costs, (80, 160, 320)))


@pytest.mark.parametrize("seed", range(3))
def test_profiles_never_tell_more_differences_than_there_are(seed):
    from plexor.llm.ngram_join import WORDS, profile

    rng = np.random.default_rng(seed)
    for n, m in ((40, 50), (96, 128), (600, 700), (30_000, 39_000)):
        both = rng.integers(-(2**62), 2**62, int(n * 0.9))
        x, y = (np.concatenate([both, rng.integers(-(2**62), 2**62, k - len(both))]) for k in (n, m))
        p, q = profile(x, n), profile(y, m)
        assert p[0] == n and q[0] == m and len(p) - 1 <= WORDS and len(p) <= len(q) <= 2 * len(p) - 1
        half = q[1:].reshape(-1, len(p) - 1)
        differ = np.bitwise_xor.reduce(np.concatenate([p[None, 1:], half]), axis=0)
        assert sum(int(w).bit_count() for w in differ.view(np.uint64).tolist()) <= n + m - 2 * len(both)


def test_regions_divide_without_loss(spark):
    """One region around a point far from all, clusters that chain across the border between pivots: every link is found, with and without division."""
    import plexor.llm.ngram_join as module
    from plexor.llm.store import Store

    rng = random.Random(21)
    base = [[rng.getrandbits(62) for _ in range(60)] for _ in range(10)]
    sets = []
    for b in base:
        for step in range(0, 40, 4):  # each links with its neighbours in the chain
            sets.append(sorted(set(b[step:] + [rng.getrandbits(62) if i % 7 == 0 else hash((b[0], i)) for i in range(step)])))
    link = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    store = Store(spark, "test-regions")
    table_ = store.put(spark.createDataFrame(list(enumerate(sets)), "c long, members array<long>"), "sets")
    facts = [("r", 1.0, i % 3 > 0, False, i, len(s), len(s), [int(x) for x in module.profile(np.array(s), len(s))], 1.0, i) for i, s in enumerate(sets)]
    state = store.put(spark.createDataFrame(facts, "g string, d double, core boolean, dense boolean, c long, n long, shared long, profile array<long>, common double, comp long").withColumn("g", F.xxhash64("g")), "state")
    cored = [f[2] for f in facts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if (cored[a] or cored[b]) and link(set(sets[a]), set(sets[b]))}
    for small, pivots in ((200, 4), (4, 4), (4, 12)):
        work = module.RegionJoin(store, table_, 75, small, pivots)
        work.run(store.put(state, "again"))
        home = list(range(len(sets)))
        find = lambda x: x if home[x] == x else find(home[x])
        for r in work.links.collect():
            assert (r.a, r.b) in want or not (cored[r.a] or cored[r.b])
            home[find(r.a)] = find(r.b)
        assert all(find(a) == find(b) for a, b in want)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    import plexor.llm.ngram_join as module
    from plexor.llm.store import Store

    monkeypatch.setattr(module, "FEW_EDGES", few)
    rng = random.Random(31)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(40)] + [(500, 300), (300, 400), (400, 500)]
    home = {}
    find = lambda x: x if home.setdefault(x, x) == x else find(home[x])
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        home[high] = low
    got = module.components(Store(spark, "test-components"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.label for r in got} == {x: find(x) for x in list(home)} and len(got) == len(home)


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 30011}" for i in range(120_000))
    rows = [(1, long), (2, long + " and more"), (3, "w1 w2 w3 w4 w5")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, table(spark, rows)).collect()}
    assert got == {1: (30011 + 0, 1), 2: (30011 + 2, 1), 3: (1, 3)}
