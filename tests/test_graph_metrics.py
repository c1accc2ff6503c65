import hashlib
import itertools
import math

import pytest
from pyspark.sql import functions as F

from plexor.operators import graph, metrics
from plexor.operators.cluster import community_start, kmeans_labels, louvain, small_community_seeds, with_isolated
from plexor.operators.consensus import coassociation, coassociation_sampled, consensus_communities, reaching
from plexor.sources.tables import settled

TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]


def edges_of(spark, layers):
    return spark.createDataFrame([(x, u, v, 1.0) for x, es in layers.items() for u, v in es], "layer string, u long, v long, w double")


def labels_of(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "node long, label long")


def planted(p_in=0.5, p_out=0.02, blocks=4, size=25, layers=("x", "y")):
    coin = lambda *k: int(hashlib.md5(repr(k).encode()).hexdigest()[:8], 16) / 2**32
    n = blocks * size
    return {x: [(u, v) for u, v in itertools.combinations(range(n), 2) if coin(x, u, v) < (p_in if u // size == v // size else p_out)] for x in layers}


@pytest.fixture(scope="module")
def two_layers(spark):
    return edges_of(spark, {"A": [*TRIANGLES, (2, 3)], "B": TRIANGLES})


def test_hand_checked_scores(spark, two_layers):
    labels = labels_of(spark, [0, 0, 0, 1, 1, 1])
    q = {r.layer: r.modularity for r in metrics.modularity(two_layers, labels).collect()}
    assert q == {"A": pytest.approx(6 / 7 - 0.5), "B": pytest.approx(0.5)}
    c = {r.layer: r.conductance for r in metrics.conductance(two_layers, labels).collect()}
    assert c == {"A": pytest.approx(1 / 7), "B": 0.0}
    assert {r.layer: r.modularity for r in metrics.modularity(two_layers, labels_of(spark, [7, 7, 7, 2, 2, 2])).collect()} == pytest.approx(q)


def test_auc_nmi_ari(spark):
    scores = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y int, score double")
    assert metrics.auc(scores).first().auc == pytest.approx(0.875)
    assert metrics.auc(scores.where("y = 1")).first().auc is None
    a, b = labels_of(spark, [0, 0, 0, 1, 1, 1]), labels_of(spark, [0, 0, 1, 1, 1, 1])
    assert metrics.nmi(metrics.contingency(a, a)).first().nmi == pytest.approx(1)
    assert metrics.ari(metrics.contingency(a, a)).first().ari == pytest.approx(1)
    assert 0 < metrics.nmi(metrics.contingency(a, b)).first().nmi < 1
    runs = spark.createDataFrame([(r, i, x) for r, row in enumerate([(0, 0, 0, 1, 1, 1), (0, 0, 1, 1, 1, 1), (0, 0, 0, 1, 1, 1)]) for i, x in enumerate(row)], "run int, node long, label long")
    assert sorted(round(r.nmi, 9) for r in metrics.pairwise_nmi(runs).collect())[-1] == 1.0
    co = {(r.u, r.v): r.c for r in coassociation(runs).collect()}
    assert (co[0, 1], co[3, 4]) == (1.0, 1.0) and co[0, 2] == pytest.approx(2 / 3) and co[2, 3] == pytest.approx(1 / 3)
    sampled = {(r.u, r.v): r.c for r in coassociation_sampled(runs, most_exact=2, most_pairs=2).collect()}
    assert all(sampled[k] <= co[k] <= 1 for k in sampled)
    assert reaching(coassociation(runs), 2.0).count() == len(co)
    nodes = spark.range(7).withColumnRenamed("id", "node")
    assert len({r.label for r in consensus_communities(coassociation(runs), nodes, 0.6).collect()}) == 3
    none = coassociation(runs).where("c > 5")
    assert {r.label for r in consensus_communities(none, nodes, 0.1).collect()} == {0}


def test_gather_ignores_nan(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "m double")
    r = metrics.gathered(rows, ["m"]).first()
    assert (r.m_mean, r.m_std) == (2.0, 1.0)


def test_layer_weights(spark):
    nnz = spark.createDataFrame([("x", 4), ("y", 8)], "layer string, nnz long")
    of = lambda *a, **k: {r.layer: r.weight for r in graph.layer_weights(nnz, *a, **k).collect()}
    assert of("inv_nnz", 4) == {"x": pytest.approx(4 / 3), "y": pytest.approx(2 / 3)}
    assert of("inv_nnz", 4, total="one") == {"x": pytest.approx(2 / 3), "y": pytest.approx(1 / 3)}
    assert sum(of("sqrt_inv_nnz", 4).values()) == pytest.approx(2)
    with pytest.raises(ValueError):
        of("custom", 4, custom={"x": 1.0})
    with pytest.raises(ValueError):
        of("other", 4)


def test_hold_out_and_negatives(spark, two_layers):
    gone = graph.held_out(two_layers, 0.3, 1)
    assert {r["layer"]: r["count"] for r in gone.groupBy("layer").count().collect()} == {"A": 2, "B": 1}
    assert graph.without(two_layers, gone).count() == 10
    assert graph.held_out(two_layers, 0.0).count() == 0
    index = spark.range(6).selectExpr("id as node", "id as idx")
    bad = graph.negative_pairs(two_layers.where("layer = 'A'"), index, 50)
    assert 0 < bad.count() <= 50 and bad.join(two_layers, ["u", "v"]).where("layer = 'A'").count() == 0
    full = edges_of(spark, {"A": list(itertools.combinations(range(6), 2))})
    assert graph.negative_pairs(full, index, 50).count() == 0  # a complete graph ends with none


def test_louvain_finds_planted_blocks(spark):
    edges = edges_of(spark, planted())
    labels = settled(louvain(edges), "labels")
    for layer in ("x", "y"):
        one = edges.where(f"layer = '{layer}'")
        got = metrics.modularity(one, labels.where(f"layer = '{layer}'").select("node", "label")).first().modularity
        want = metrics.modularity(one, labels_of(spark, [i // 25 for i in range(100)])).first().modularity
        assert got >= want - 1e-6


def test_starts_and_seeds(spark):
    nodes = spark.range(7).withColumnRenamed("id", "node")
    labels = with_isolated(louvain(edges_of(spark, {"A": TRIANGLES})).select("node", "label"), nodes)
    assert len({r.label for r in labels.collect()}) == 3
    start = {r.node: r.h for r in community_start(labels, nodes, 2).collect()}
    assert sum(max(h) == 1.0 for h in start.values()) in (4, 6) and min(min(h) for h in start.values()) == 1e-8
    wrapped = community_start(labels, nodes, 2, modulo=True, noise=0.1)
    assert all(math.isclose(sum(r.h), 1) for r in wrapped.collect())
    assert small_community_seeds(labels, 7, share=0.5, most=1).count() == 1


def test_kmeans(spark):
    h = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 2.0 + i]) for i in range(20)], "node long, h array<double>")
    got = {r.node: r.label for r in kmeans_labels(h, 2, normalise=True, starts=2).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and got[0] != got[1]


def test_clean_up_sees_the_edges_of_every_part(spark):
    from collections import Counter

    from plexor.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    layer = {r.o_orderkey: r.o_orderpriority for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
    parts = {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").collect():
        parts.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    want = Counter((layer[o], u, v) for o, ps in parts.items() for u in ps for v in ps)
    got = lambda name, n: {(r.layer, r.u, r.v): r[n] for r in QUERIES[name](spark, d).collect()}
    assert got("ag2_sum_dups", "w") == want
    assert got("ag1_clip_dups", "w") == dict.fromkeys(want, 1.0)
    assert got("pf3_no_loops", "n") == {k: n for k, n in want.items() if k[1] != k[2]}
    assert any(u % 10 for _, u, _ in want)


def test_louvain_runs_until_no_move_gains(spark):
    """In the end no two communities are better as one: on a long path that takes several levels."""
    n, rounds = 200, []
    label = {r.node: r.label for r in louvain(edges_of(spark, {"A": [(i, i + 1) for i in range(n)]}), tol=0.0, rounds=rounds).collect()}
    filled, links = {}, {}
    for i in range(n):
        for end in (i, i + 1):
            filled[label[end]] = filled.get(label[end], 0) + 1
        pair = frozenset((label[i], label[i + 1]))
        links[pair] = links.get(pair, 0) + 1
    for pair, w in links.items():
        if len(pair) == 2:
            assert w <= math.prod(filled[x] for x in pair) / (2 * n) + 1e-9
    assert len(rounds) > 2


@pytest.mark.parametrize("salts", [1, 32])
def test_a_round_gains_at_least_what_it_says(spark, salts):
    """Weighted layers, a hub, loops: modularity after a round of moves made at once is no less than the sum of their bounds, and many are made."""
    from plexor.operators.cluster import _round

    rng = __import__("random").Random(salts)
    weights = {}
    for _ in range(900):
        u, v = sorted((rng.randrange(120), rng.randrange(120)))
        weights[u, v] = weights.get((u, v), 0) + rng.choice([0.3, 1.0, 2.5])
    weights |= {(0, v): 1.0 for v in range(1, 120)}
    two_m = 2 * sum(weights.values())
    strength = dict.fromkeys(range(120), 0.0)
    for (u, v), w in weights.items():
        strength[u] += w
        strength[v] += w
    links = spark.createDataFrame([("A", *e, w) for (u, v), w in weights.items() if u != v for e in ((u, v), (v, u))], "layer string, u long, v long, w double")

    def modularity(label):
        inside, full = 0.0, {}
        for (u, v), w in weights.items():
            inside += 2 * w * (label[u] == label[v])
        for x, k in strength.items():
            full[label[x]] = full.get(label[x], 0) + k
        return inside / two_m - sum((f / two_m) ** 2 for f in full.values())

    label, moved = {x: x for x in range(120)}, []
    for _ in range(4):
        state = spark.createDataFrame([("A", x, label[x], strength[x], two_m) for x in range(120)], "layer string, node long, label long, k double, two_m double")
        got = _round(links, state, salts).collect()
        new = {r.node: r.label for r in got}
        gained = [r.gained for r in got if r.gained is not None]
        assert gained and min(gained) > 0 and modularity(new) - modularity(label) >= sum(gained) - 1e-9
        moved.append(len(gained))
        label = new
    assert max(moved) >= 10


def test_louvain_takes_few_rounds_on_planted_blocks(spark):
    """40 planted blocks of 50 nodes: every one is found, in a stated number of rounds."""
    nodes = spark.range(2_000)
    inner = nodes.select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(49))).alias("step")).select("u", (F.col("u") + F.col("step")).alias("v")).where("floor(u / 50) = floor(v / 50)")
    outer = nodes.select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("u", F.pmod(F.xxhash64("u", "i"), F.lit(2_000)).alias("v")).where("u < v").distinct()
    edges = settled(inner.unionByName(outer).distinct().select(F.lit("A").alias("layer"), "u", "v", F.lit(1.0).alias("w")), "planted")
    assert edges.count() > 49_000
    rounds = []
    labels = louvain(edges, rounds=rounds)
    assert sum(rounds) <= 30
    per = labels.groupBy(F.floor(F.col("node") / 50).alias("block")).agg(F.countDistinct("label").alias("k"), F.min("label").alias("label"))
    assert {r.k for r in per.collect()} == {1} and per.select("label").distinct().count() == 40


def test_kmeans_runs_share_their_passes(spark):
    """Ten starts, one pass an iteration: the best is no worse than a run in numpy from the same centres, and three blobs are found."""
    import numpy as np

    from plexor.operators import cluster

    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(c, 0.2, (40, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 3))])
    h = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, h array<double>")
    starts = cluster.seeded_centres(h, 3, 4, 0)
    assert [c.shape for c in starts] == [(3, 3)] * 4
    sums = cluster.lloyd_sums(h, starts)
    for c, s in zip(starts, sums):
        at = ((points[:, None] - c) ** 2).sum(axis=2)
        near = at.argmin(axis=1)
        assert np.allclose(s[:, -2], np.bincount(near, minlength=3)) and np.isclose(s[:, -1].sum(), at.min(axis=1).sum())
        assert np.allclose(cluster.moved_centres(c, s)[near], np.array([points[near == k].mean(axis=0) for k in near]))
    got = {r.node: r.label for r in kmeans_labels(h, 3).collect()}
    assert [len({got[i] for i in range(40 * b, 40 * b + 40)}) for b in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    assert kmeans_labels(h.limit(0), 3).count() == 0
    assert len({r.label for r in kmeans_labels(h.limit(2), 5).collect()}) <= 2


@pytest.mark.parametrize("cell", [1, 3, 512])
def test_a_large_cluster_meets_in_cells(spark, cell):
    """Pairs are the same however clusters are cut, and no key holds more than about two cells."""
    from plexor.operators.consensus import celled

    rng = __import__("random").Random(cell)
    rows = [(run, i, 0 if i < 40 else rng.randrange(3)) for run in range(3) for i in range(60)]
    runs = spark.createDataFrame(rows, "run int, node long, label long")
    got = {(r.u, r.v): round(r.c * 3) for r in coassociation(runs, cell).collect()}
    label = {(run, i): x for run, i, x in rows}
    want = {(u, v): sum(label[r, u] == label[r, v] for r in range(3)) for u, v in itertools.combinations(range(60), 2)}
    assert got == {k: n for k, n in want.items() if n}
    most = max(r["count"] for r in celled(runs, cell).groupBy("run", "label", "low", "high").count().collect())
    assert most <= (60 if cell == 512 else 2 * cell + 12)


@pytest.mark.parametrize("block, hub", [(40, 10**6), (40, 60), (10**6, 10**6)])
def test_offers_by_blocks_are_those_of_the_plan(spark, block, hub):
    """Two layers, a hub, a node without links: the same offers however nodes are dealt, and edges stay where they are."""
    from plexor.operators.cluster import _blockwise, _known, _offers
    from plexor.operators.offers import Neighbours

    rng = __import__("random").Random(block)
    pairs = {(layer, *sorted(rng.sample(range(100), 2))): rng.choice([0.3, 1.0, 2.5]) for layer in (0, 1) for _ in range(300)} | {(1, 0, v): 1.0 for v in range(1, 100)}
    rows = [(x, *e, w) for (x, u, v), w in pairs.items() for e in ((u, v), (v, u))]
    links = settled(spark.createDataFrame(rows, "layer int, u long, v long, w double"), "links")
    state = spark.createDataFrame([(x, i, i % 23, math.fsum(w for a, u, _, w in rows if (a, u) == (x, i)), 900.0) for x in (0, 1) for i in range(101)], "layer int, node long, label long, k double, two_m double")
    near = Neighbours(links, state, block, hub)
    assert (near.hubs is not None) == (hub == 60)
    of = lambda df: {(r.layer, r.node): (r.own, r.to, pytest.approx(r.prior)) for r in df.collect()}
    got = {(r.layer, r.node): (r.own, r.to, r.prior) for r in _blockwise(near, state).collect()}
    assert got == of(_offers(links, state)) and len(got) > 50
    plan = near.moves(_known(state, "total"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2
    near.forget()


def test_louvain_clears_its_shuffle_files(spark, monkeypatch):
    """What rounds shuffle goes before the next; a level's edges are not written in both directions, and not shuffled again after they are packed."""
    import time

    from plexor.operators import cluster, offers

    monkeypatch.setattr(cluster, "SWEPT", 0)
    files, names, packed = [], [], []

    def counted(near, state, of=cluster._blockwise):
        time.sleep(1)  # files are deleted in the background
        files.append(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length())
        return of(near, state)

    def noted(self, df, key, name, of=offers.Neighbours._bucketed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        packed.append((plan.count("Exchange "), plan.count("REPARTITION_BY_NUM")))
        return of(self, df, key, name)

    monkeypatch.setattr(cluster, "_blockwise", counted)
    monkeypatch.setattr(cluster, "settled", lambda df, name: names.append(name) or settled(df, name))
    monkeypatch.setattr(offers.Neighbours, "_bucketed", noted)
    edges = settled(edges_of(spark, planted(layers=("x",))), "edges")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rounds = []
        assert len({r.label for r in louvain(edges, rounds=rounds).collect()}) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(files) == sum(rounds) > 4 and max(files) <= 60 and "both" not in names
    packed.clear()
    links = settled(graph.symmetric(edges).withColumn("layer", F.lit(0)), "links")
    offers.Neighbours(links, links.select("layer", F.col("u").alias("node")).distinct(), 40).forget()
    assert all(dealt == 2 for _, dealt in packed) and [n for n, _ in packed] == [3, 3]  # the third: distinct() of this test


def test_grouped_modularity_is_that_of_the_edges(spark):
    """Groups listed twice, of one member, in two layers, and a member without a label."""
    rng = __import__("random").Random(3)
    groups = {g: set(rng.sample(range(20), rng.randrange(1, 6))) for g in range(60)}
    layer = [(g, x) for g in groups for x in (["a", "b"] if g == 7 else ["ab"[g % 2]])]
    shared = {}
    for g, x in layer:
        for u, v in itertools.combinations(sorted(groups[g]), 2):
            shared[x, u, v] = shared.get((x, u, v), 0.0) + 1
    edges = spark.createDataFrame([(*e, w) for e, w in shared.items()], "layer string, u long, v long, w double")
    labels = labels_of(spark, [i % 4 for i in range(19)])
    members = spark.createDataFrame([(g, i) for g, some in groups.items() for i in [*some, min(some)]], "group long, node long")
    layers = spark.createDataFrame(layer + layer[:3], "group long, layer string")
    of = lambda df: {r.layer: pytest.approx(r.modularity, rel=1e-12) for r in df.collect()}
    got = of(metrics.grouped_modularity(members, layers, labels))
    assert len(got) == 2 and {x: q.expected for x, q in got.items()} == of(metrics.modularity(edges, labels))


@pytest.mark.parametrize("hub", [60, 10**6])
def test_communities_edges_come_from_blocks(spark, hub):
    """A level's end adds edges up where they are packed: as joins would, with and without a hub; strengths too."""
    from plexor.operators.cluster import _known
    from plexor.operators.offers import Neighbours

    rng = __import__("random").Random(hub)
    pairs = {(layer, *sorted(rng.sample(range(100), 2))): rng.choice([0.3, 1.0, 2.5]) for layer in (0, 1) for _ in range(300)} | {(1, 0, v): 1.0 for v in range(1, 100)}
    links = settled(spark.createDataFrame([(*e, w) for e, w in pairs.items()], "layer int, u long, v long, w double"), "links")
    near = Neighbours(links, spark.createDataFrame([(0, 5, 2.0), (1, 200, 3.0)], "layer int, node long, more double"), 40, hub, mirrored=True)
    assert (near.hubs is not None) == (hub == 60) and near.count > 10
    k, sums = {(0, 5): 2.0, (1, 200): 3.0}, {}
    for (x, u, v), w in pairs.items():
        for end in (u, v):
            k[x, end] = k.get((x, end), 0.0) + w
        at = (x, *sorted((u % 7, v % 7)))
        sums[at] = sums.get(at, 0.0) + w
    nodes = settled(near.nodes(), "nodes")
    assert {(r.layer, r.node): pytest.approx(r.k) for r in nodes.collect()} == k and nodes.count() == len(k)
    state = nodes.select("layer", "node", (F.col("node") % 7).alias("label"), "k", F.lit(900.0).alias("two_m"))
    merged = near.merged(_known(state, "total")).groupBy("layer", "u", "v").agg(F.sum("w").alias("w"))
    assert {(r.layer, r.u, r.v): pytest.approx(r.w) for r in merged.collect()} == sums
    near.forget()


def test_near_numbers_share_blocks(spark):
    """A ring asks its blocks' neighbours only; numbers that crowd in one place go by hash, evenly."""
    from plexor.operators.offers import Neighbours

    ring = settled(spark.range(4_000).select(F.lit(0).alias("layer"), F.col("id").alias("u"), ((F.col("id") + 1) % 4_000).alias("v"), F.lit(1.0).alias("w")), "ring")
    none = spark.createDataFrame([], "layer int, node long")
    near = Neighbours(ring, none, 400, mirrored=True)
    assert near.count == 20 and {len(r.targets) for r in near.asked.collect()} == {3}
    near.forget()
    crowded = ring.unionByName(spark.createDataFrame([(0, 0, 10**9, 1.0)], "layer int, u long, v long, w double"))
    near = Neighbours(crowded, none, 400, mirrored=True)
    assert near.width is None and max(len(r.near) for r in near.edges.collect()) < 8 * 500
    near.forget()


def test_baseline_shuffles_pairs_once(spark, monkeypatch):
    """ml13: the layers' sum is read from a pair's counts; communities' modularity as from the edges."""
    from plexor.operators import cluster
    from plexor.plans import queries

    d, names, kept = "/root/testdata/sf0.001", [], {}

    def noted(df, name="table"):
        names.append(name)
        kept[name] = settled(df, name)
        return kept[name]

    edges = settled(queries.mx(spark, d), "mx")
    want = {(r.u, r.v): pytest.approx(r.w) for r in graph.aggregate_layers(edges, graph.layer_weights(graph.entries(edges), "inv_nnz", 0, total="one")).collect()}
    assert {(r.u, r.v): r.w for r in queries.whole_of(spark, d, "inv_nnz").collect()} == want and want
    monkeypatch.setattr(queries, "settled", noted)
    monkeypatch.setattr(cluster, "settled", noted)
    got = {r.layer: r.modularity for r in queries.ml13_baseline(spark, d).collect()}
    assert "mx" not in names and "louvain" not in names and names.count("counts") == 1
    assert got == {r.layer: pytest.approx(r.modularity) for r in metrics.modularity(edges, kept["labels"]).collect()}


def test_blocks_move_their_own_nodes_first(spark):
    """Blocks are ranges of one layer after the other; before any round they find communities of their own nodes, and so most of the modularity."""
    from plexor.operators.offers import Neighbours

    links = settled(edges_of(spark, planted(layers=("0", "1"))).withColumn("layer", F.col("layer").cast("int")), "links")
    near = Neighbours(links, spark.createDataFrame([(1, 100, 3.0)], "layer int, node long, more double"), 400, mirrored=True)
    places = {(r.layer, r.node): r.b for r in near.nodes().collect()}
    assert near.count > 4 and {len({x for (x, _), b in places.items() if b == i}) for i in set(places.values())} <= {1, 2} and len(set(places.values())) == near.count
    assert sum(len({x for (x, _), b in places.items() if b == i}) == 2 for i in set(places.values())) <= 1
    two_m = {r.layer: r.m for r in links.groupBy("layer").agg((2 * F.sum("w")).alias("m")).collect()}
    start = settled(near.started(two_m, 5), "start")
    assert {(r.layer, r.node) for r in start.collect()} == set(places) and all(places[r.layer, r.label] == places[r.layer, r.node] for r in start.collect())
    assert sorted(start.collect()) == sorted(near.started(two_m, 5).collect()) and {(r.layer, r.node): r.k for r in start.collect()}[1, 100] == 3.0
    for layer in (0, 1):
        one = links.where(F.col("layer") == layer)
        assert metrics.modularity(one, start.where(F.col("layer") == layer).select("node", "label")).first().modularity > 0.25
    near.forget()


def test_passes_over_a_block_end_where_no_node_gains():
    """Two triangles joined by an edge, as places and links of a block."""
    from plexor.operators.offers import _passed

    ends = sorted((a, b) for e in [*TRIANGLES, (2, 3)] for a, b in (e, e[::-1]))
    cut = [sum(a < x for a, _ in ends) for x in range(7)]
    k = [float(cut[x + 1] - cut[x]) for x in range(6)]
    label = _passed(cut, [b for _, b in ends], [1.0] * len(ends), k, [14.0] * 6, [3, 1, 0, 5, 2, 4])
    assert len(set(label[:3])) == len(set(label[3:])) == 1 and label[0] != label[3]


def test_a_layer_without_weight_stays_as_it_is():
    """Its nodes have no strength to divide by; those of the other layer move."""
    import pyarrow as pa

    from plexor.operators import offers

    ends = [(x, u, v, float(x), 0, 0) for x in (0, 1) for u, v in TRIANGLES]
    names, kinds = ["layer", "u", "v", "w", "b", "far"], [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    dealt = offers._packer(True)([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends), kinds)], names)])
    own = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.float64())], ["layer", "node", "more"])
    edges = offers._gathered(pa.Table.from_batches(dealt), own)
    (out,) = offers._starter({0: 0.0, 1: 12.0}, 0)(edges.to_batches())
    label = {(r["layer"], r["node"]): r["label"] for r in out.to_pylist()}
    assert all(label[0, i] == i for i in range(6)) and len({label[1, i] for i in range(6)}) == 2
