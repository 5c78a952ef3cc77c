import hashlib
import random

import numpy as np
import pytest

from tessera.llm import queries, repeats, storage
from tessera.llm.repeats import repeat_report, repeated_starts, without_repeats


def plain(rows, length):
    seen = {}
    texts = [(k, (t or "").encode()) for k, t in rows]
    for i, (_, t) in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    gone = [np.zeros(len(t), bool) for _, t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = []
    for (k, t), g in zip(texts, gone, strict=True):
        edges = np.diff(np.concatenate([[0], g.astype(int)]))
        out.append((k, len(t), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(r.randrange(20, 120))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(1, 150))))
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "ab" * 3000), (105, "x" * 399), (106, "x" * 400), (107, "y" * 401), (108, rows[5][1][:-1]), (109, rows[5][1][3:]), (110, "zz" + passages[0] * 3)]
    return rows


def test_kernel_against_brute_force():
    r = np.random.default_rng(1)
    for length in (16, 40, 100):
        data = r.integers(97, 99, 3000).astype(np.uint8)
        data[1000:1300] = data[200:500]
        bounds = np.array([0, 700, 701, 1600, 3000])
        room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(3000)
        owned = room >= length
        got = repeated_starts(data, bounds, owned, length)
        seen = {}
        for p in np.flatnonzero(owned).tolist():
            seen.setdefault(data[p : p + length].tobytes(), []).append(p)
        want = sorted(p for v in seen.values() if len(v) > 1 for p in v)
        assert np.flatnonzero(got).tolist() == want


@pytest.mark.parametrize("cap", [1000, 3])
def test_against_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", cap)
    monkeypatch.setattr(repeats, "SORT_BYTES", 5000)
    if cap == 3:  # hot texts and a sieve that lets nearly all pass, too
        monkeypatch.setattr(repeats, "HOT_SHARE", 30)
        monkeypatch.setattr(storage, "SIEVE_BITS", 7)
    rows = corpus(cap)
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, key string, spans string").repartition(3)
    for length in (400, 120):
        assert sorted(map(tuple, repeat_report(df, length).collect()), key=str) == plain(rows, length)
    kept = without_repeats(df, 400).collect()
    assert {r.doc_id: r.text for r in kept}[105] == "x" * 399 and {r.key for r in kept} == {"x"}


def test_repeated_and_empty(spark):
    rows = [(1, "q" * 50 + "word " * 200), (1, "q" * 50 + "word " * 200), (None, "lone " + "".join(map(str, range(300)))), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeat_report(df).collect()), key=str) == plain(rows, 400)
    assert repeat_report(df.limit(0)).count() == 0


def test_query_gives_the_kept_text(spark, tmp_path):
    passage = " ".join(f"wörd{k}é" for k in range(60))
    rows = [(1, f"one {passage}é tail"), (2, f"two {passage}è end"), (3, "three stays é"), (4, None), (5, "€" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op7_repeats(spark, str(tmp_path)).collect()}
    assert sorted(tuple(r)[:5] for r in found.values()) == plain(rows, 400)
    # The first byte of é and è repeats too, so a character is cut in part there; it goes whole.
    assert {k: r.text for k, r in found.items()} == {1: "one tail", 2: "two end", 3: "three stays é", 4: "", 5: ""}


def test_anchor_with_many_contexts(spark, monkeypatch):
    """A short line in front of many texts: its anchors have more contexts than one sort takes, some strings repeat."""
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", 4)
    r = random.Random(8)
    line, word = "All of this is one common line, met in many texts. ", lambda: "".join(r.choice("abcde") for _ in range(5))
    shared = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(40)) + line + (shared if i % 4 == 0 else "") + " ".join(word() for _ in range(40))) for i in range(40)]
    rows += [(100 + i, line * 9 + word()) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (400, 150, 60):
        assert sorted(map(tuple, repeat_report(df, length).collect()), key=str) == plain(rows, length)


def test_memory_of_a_sort():
    """A sort holds less than 80 bytes for each byte of its contexts."""
    import tracemalloc

    text = np.random.default_rng(0).integers(97, 123, 512).astype(np.uint8)
    data, bounds = np.tile(text, 200), np.arange(0, 200 * 512 + 1, 512)
    owned = np.repeat(bounds[1:], 512) - np.arange(len(data)) >= 400
    tracemalloc.start()
    found = repeated_starts(data, bounds, owned, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, owned) and peak < 80 * len(data)
