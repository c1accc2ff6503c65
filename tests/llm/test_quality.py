import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plexor.llm import quality_fm
from plexor.llm.quality_rules import kept_documents, quality_rules
from plexor.llm.words import slabs, windows


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(12, 60))
        rows.append((i, " ".join(x + "$$$" for x in w) if i % 7 == 0 else ". ".join(w).capitalize()))
    return rows


def rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(grams)
    cover = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


ODD = [None, "", " \n ", "a", "a b c d e a b c d e", "x\ny\nx\n\n \nx ", "É#é z|　<>", "l\n" * 500, "\n", "a\n", "end\nend"]


def test_rules_against_brute_force(spark):
    rows = corpus(60, 1) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "w " * 30), (3, "repeated id " * 9)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, kept string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(60)] + [(1, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality_rules(spark, docs, labels).collect()
    want = Counter(rules(t) for _, t in rows)
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 3}
    assert not any(by[i] for i in by if i % 7 == 0) and all(by[i] for i in by if i % 7)
    kept = kept_documents(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_rules_without_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "short")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality_rules(spark, docs, none).orderBy("doc_id").collect()] == [True, False]
    assert quality_rules(spark, docs.where(F.lit(False)), none).count() == 0
    assert kept_documents(spark, docs.where(F.lit(False)), none).count() == 0


def test_machine_on_held_out_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in corpus(400, 2)] + [(900, None, "x", 1), (901, "", "x", 1), (902, "long " * 20000, "x", 1)], "doc_id long, text string, y string, score int")
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 7 > 0).cast("int").alias("y"))
    machine = quality_fm.train(docs, labels.where("doc_id < 250"))
    got = {r.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 403
    held = range(250, 400)
    assert sum((got[i] >= 0.3) == (i % 7 > 0) for i in held) / len(held) > 0.95
    again = quality_fm.train(docs, labels.where("doc_id < 250"))
    assert np.array_equal(machine.linear, again.linear)


def test_machine_without_two_kinds(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, y int")
    assert abs(quality_fm.score(docs, quality_fm.train(docs, none)).first().score - 0.5) < 1e-6
    assert quality_fm.score(docs.where(F.lit(False)), quality_fm.train(docs, none)).count() == 0


def test_pairwise_terms_match_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality_fm.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    c, x = rng.integers(0, 50, 9), rng.normal(size=9)
    pairs = sum(m.factors[c[i]] @ m.factors[c[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert np.allclose(m.margins(c, x, np.array([0, 9])), 0.1 + m.linear[c] @ x + pairs)


def test_metadata_is_a_feature_of_the_general_operator(spark):
    docs = spark.createDataFrame([(i, "same text", "good" if i % 2 else "bad") for i in range(200)] + [(999, "same text", None)], "doc_id long, text string, site string")
    labels = docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    got = {r.doc_id: r.score for r in quality_fm.score(docs, quality_fm.train(docs, labels, ["site"]), ["site"]).collect()}
    assert got[1] > 0.8 and got[0] < 0.2 and 0 <= got[999] <= 1


def test_windows_of_words():
    texts = ["a b c d e f", None, "a b", "", "B c d e f g"]
    (slab,) = slabs(pa.array(texts))
    slab.prepare(lower=True)
    starts, ends, bounds = slab.words()
    h, at = windows(slab.hashes(starts, ends), bounds, 5)
    assert np.diff(at).tolist() == [2, 0, 1, 0, 2]
    assert h[1] == h[3] and len(set(h.tolist())) == 4
