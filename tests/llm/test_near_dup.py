import random
import re

import pytest

from tessera.llm import components as components_module, near_dup
from tessera.llm.components import components
from tessera.llm.near_dup import near_duplicates


def plain(rows, width, percent):
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[key] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return sorted((k, len(sets[k]), top(k), top(k) == k) for k in keys)


def corpus():
    r = random.Random(5)
    rows, key = [], 0

    def add(words):
        nonlocal key
        rows.append((key, " ".join(words) if words is not None else None))
        key += 1

    for family in range(25):
        base = [r.choice("the of and".split()) if r.random() < 0.3 else f"w{r.randrange(4000)}" for _ in range(r.randrange(20, 300))]
        for _ in range(r.choice((1, 2, 3, 8, 90 if family == 3 else 4))):
            own = list(base)
            for _ in range(r.randrange(0, max(1, len(own) // 30))):
                own[r.randrange(len(own))] = f"x{r.randrange(100_000)}"
            add(own if r.random() < 0.7 else [w.upper() for w in own])
    for t in (None, [], ["one"], ["ONE"], ["one", "two"], ["one", "two"], ["é", "ü", "É"], ["a"] * 9):
        add(t)
    r.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n string").repartition(3)
    for width, percent in ((3, 85), (5, 80)):
        assert sorted(map(tuple, near_duplicates(df, width, percent).collect())) == plain(rows, width, percent)


def test_branching_and_blocks(spark, monkeypatch):
    """Leaves of four members and few levels: families pass through every level into the blocks."""
    for name, value in (("LEAF", 4), ("BLOCK", 6), ("MAX_DEPTH", 5), ("SLICE_ITEMS", 60), ("PIVOTS", 2), ("WIDE", 20)):
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 3, 85).collect())) == plain(rows, 3, 85)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (None, 0, None, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [0, 400_000])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(components_module, "TASK_EDGES", bound)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 39), (300, 301), (301, 302), (302, 300), (9, 9)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(7, 40)]}, **{i: 300 for i in range(300, 303)}}
