import zlib
from collections import Counter, defaultdict

from plexor.llm.sharding import read_shard, shard

KIND = "doc_id long, text string, size int, key string, chunk int, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, "", 0, "") for i, t in rows], KIND)


def test_laws(spark):
    rows = [(i, f"word{i % 50} " * (1 + i % 37)) for i in range(600)] + [(1000 + i, "hot text") for i in range(300)] + [(2000, None), (2001, ""), (2002, "long " * 3000), (None, "no id"), (5, "word5 " * 6)]
    got = shard(spark, table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    assert [t for t, s in homes.items() if len(s) > 1] == ["hot text"]  # a third of the rows; whole it could not balance
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    rest = [v for k, v in sizes.items() if k not in homes["long " * 3000]]
    assert max(rest) < 1.1 * min(rest)


def test_reruns_agree_and_read_back(spark):
    docs = table(spark, [(i, f"t{i}") for i in range(100)])
    first, second = shard(spark, docs, shards=4), shard(spark, docs, shards=4)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    assert sum(len(list(read_shard(first, k))) for k in range(4)) == 100


def test_empty_table(spark):
    assert shard(spark, table(spark, [])).count() == 0
