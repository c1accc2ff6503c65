import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plexor.llm.mixing import min_cost_flow, mix, mixed_documents, targets


def test_targets_are_reshared_until_none_is_above():
    assert targets({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = targets({"a": 10, "b": 100, None: 1000, "c": 500})
    assert got["a"] == 30.0 and sum(got.values()) == pytest.approx(1610)
    assert got["b"] == 300.0 and got["c"] / got[None] == pytest.approx(1 / 5)  # order a, b, c, null: weights 5, 2, 1, 5
    assert targets({}) == {}
    assert targets({"a": 0}) == {"a": 0.0}


def test_flow_serves_overlapping_sources_with_least_repetition():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    flow = min_cost_flow({a: 10, b: 10, ab: 10}, {"a": 25.0, "b": 5.0}, 3)
    assert sum(v for (p, s), v in flow.items() if s == "a") == pytest.approx(25)
    assert sum(v for (p, s), v in flow.items() if s == "b") == pytest.approx(5)
    assert flow[b, "b"] == pytest.approx(5) and flow[ab, "a"] + flow[a, "a"] == pytest.approx(25)
    assert max(flow[a, "a"], flow[ab, "a"]) <= 20  # the second time of both before the third of either


def corpus():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["src0"] * 6 + ["b", "é", None])) for i in range(800)]
    return rows + [(2000, None, "b"), (2001, "", "b"), (2002, "x\x0by z", "only"), (None, "no id", "b"), (5, "again again", "src0")]


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    got = mix(spark, docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix(spark, docs).collect()))
    source_size, taken = Counter(), Counter()
    for i, t, s in rows:
        source_size[s] += len((t or "").split())
    want = targets(dict(source_size))
    for r in got:
        (s,) = r.sources
        taken[s] += r.taken
        assert r.source_size == source_size[s] and r.target == pytest.approx(want[s])
        assert r.taken in {k * r.size for k in range(4)}
    for s in want:
        assert abs(taken[s] - want[s]) <= 3
    assert mix(spark, docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_long_document_is_passed_over(spark, seed):
    """Source a may draw 1200 words: its 200 short documents have them, its long one never fits."""
    rows = [(i, "w " * 10, "a") for i in range(200)] + [(200, "w " * 1500, "a")] + [(300 + i, "w " * 100, "b") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(spark, docs, weights=(1200.0, 3500.0), seed=seed).collect()
    assert sum(r.taken for r in got if r.sources == ["a"]) == 1200
    assert sum(r.taken for r in got if r.sources == ["b"]) == 3500
    again = mix(spark, docs, weights=(1234.5, 3465.5), seed=seed).collect()
    left = 1234.5 - sum(r.taken for r in again if r.sources == ["a"])
    assert 0 <= left < min(r.size for r in again if r.sources == ["a"] and not r.taken)


def test_overlapping_membership(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(300)], "doc_id long, text string, sources array<string>")
    got = mix(spark, docs, members=F.col("sources"), weights=(2.0, 1.0)).collect()
    assert sum(r.taken for r in got) == pytest.approx(4000, abs=30)  # shares of both sources' sizes, 2000 each
    assert max(r.taken for r in got) <= 30


def test_repeated_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in corpus()], "doc_id long, text string, source string, __times int, __copy int")
    out = mixed_documents(spark, docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert max(times.values()) <= 6 and 2000 not in times
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in mix(spark, docs).collect())


def test_rows_without_an_id_are_mixed(spark):
    rows = [(None, f"w{i} " * 10, "a") for i in range(40)] + [(None, "alike " * 10, "a")] * 30 + [(i, "b " * 10, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mix(spark, docs).collect()
    out = mixed_documents(spark, docs).collect()
    assert sum(r.taken for r in taken if r.sources == ["a"]) == sum(10 for r in out if r.source == "a") > 700
    assert all(r.doc_id is None for r in out if r.source == "a")


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    from plexor.llm.store import Store

    store = Store(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = store.put(stage(spark, docs, d), name)
        assert out.columns == docs.columns
        after = out.count()
        assert 0 < after <= before and out.select("doc_id").distinct().count() == after
        docs, before = out, after
    packed = corpus_pipeline.pack(spark, corpus_pipeline.mix_sources(spark, docs, d), d)
    assert packed.where("offset + length > 4096").count() == 0
    assert packed.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0
    from plexor.llm.ngram_join import near_duplicates

    assert near_duplicates(spark, docs).where("doc_id <> component_id").count() == 0


def test_whole_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing names, through run()."""
    import corpus_pipeline

    rng = random.Random(17)
    words = [("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    plain = [(i, text(60), "en", f"src{i % 3}", 1) for i in range(60)]
    near = plain[3][1].split()
    near[30] = "other"
    rows = plain + [plain[0], (70, plain[1][1] + " ", "en", "src1", 1), (None, plain[2][1], None, None, None), (None, " ".join(plain[5][1].split()[:40] + plain[6][1].split()[:40]), None, None, None), (71, " ".join(near), "en", "src0", 1), (72, None, "en", "src0", 1), (73, "", None, "src1", None), (74, text(30_000), "en", "src2", 1), (None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, __id int, kept int, row int"
    spark.createDataFrame([(*r, 1, 2, 3) for r in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(74, 1, 0), (74, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, d)
        assert out.columns == docs.columns
    kept = out.collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == [*range(60), 74] and ids.count(None) == 1
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} <= {*range(60), 74, None} and max(r.offset + r.length for r in packed) <= 4096
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
