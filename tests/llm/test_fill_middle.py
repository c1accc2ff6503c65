import hashlib
import random
import re

import pytest

from plexor.llm.fill_middle import END, POINT, SENTINEL, UNIT, assembled, automaton, draws, fill_in_middle, restored, transitions

SENTINELS = (b"<P>", b"<S>", b"<M>")
TEXTS = ["", None, "\n", "one", "one\n", "a\nb\nc", "é\n日本\n😀x\n\n", "x<P>y\n", "<<P\n<M", "<M>", "\r\n\x0b\n", "word " * 40_000 + "\n" + "z" * 5, "\n" * 300, "<\n" * 50]


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = [int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, n string, form int, output string")


def test_every_text_as_by_hand(spark):
    rows = [(i * 14 + j, t) for i, t in enumerate(TEXTS) for j in range(14)] + [(5, "same\nrow"), (5, "same\nrow")]
    got = fill_in_middle(table(spark, rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got))) == sorted(str(brute(*r)) for r in rows)
    for r in got:
        assert hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_rows_and_no_id(spark):
    assert fill_in_middle(table(spark, [])).collect() == []
    (row,) = fill_in_middle(table(spark, [(None, "a\nb\n")]), outputs=False).collect()
    assert row.doc_id is None and row.n == 2 and row.restored_sha256 == hashlib.sha256(b"a\nb\n").hexdigest()


def test_percentages_and_other_units(spark):
    rows = [(i, "a b\nc d") for i in range(200)]
    got = fill_in_middle(table(spark, rows), fim_percent=40, spm_percent=0).collect()
    assert {r.form for r in got} == {"plain", "psm"}
    assert [r.form for r in sorted(got, key=lambda r: r.doc_id)] == ["plain" if draws(7, i)[2] % 100 >= 40 else "psm" for i in range(200)]
    assert {r.n for r in fill_in_middle(table(spark, rows), closers=b" \n", outputs=False).collect()} == {4}


@pytest.mark.parametrize("lanes", [1, 2, 7, 1024])
def test_the_scan_counts_what_a_reader_of_one_byte_at_a_time_does(lanes):
    rng = random.Random(lanes)
    sentinels = (b"<P>", b"<<PP", b"PP<")
    table = automaton(sentinels)
    for _ in range(20):
        text = "".join(rng.choice("<P>\nxé日😀") for _ in range(rng.randrange(200)))
        data = text.encode()
        bits = transitions(table, __import__("numpy").array([*data, END], "uint16"), lanes)
        assert sum(bool(b & POINT) for b in bits[:-1]) == len(text)
        assert sum(bool(b & UNIT) for b in bits) == len(re.findall(r"[^\n]*\n|[^\n]+", text))
        ends = {i + len(s) - 1 for s in sentinels for i in range(len(data)) if data.startswith(s, i)}
        assert {i for i, b in enumerate(bits) if b & SENTINEL} >= {e for e in ends} and all(any(data[: i + 1].endswith(s) for s in sentinels) for i, b in enumerate(bits) if b & SENTINEL)


def test_forms_are_undone():
    for form in ("plain", "psm", "spm"):
        for parts in ((b"", b"", b""), (b"a\n", b"", b"c"), (b"", b"b<", b"P>")):
            assert restored(form, assembled(form, parts, SENTINELS), SENTINELS) == b"".join(parts)
