import random
import re

from tessera.llm import decontaminate
from tessera.llm.decontaminate import MIN_SHARE, MIN_TOKENS, overlaps, without_leaks

R = random.Random(2)


def word():
    return "".join(R.choice("aeioulnrst") for _ in range(R.randrange(2, 8)))


def data():
    items = [(i, " ".join(word() for _ in range(R.randrange(15, 50)))) for i in range(30)]
    rows, want = [], {}
    for i in range(90):
        text = [word() for _ in range(R.randrange(0, 120))]
        if i % 3 == 0:
            item, passage = R.choice(items)
            passage = passage.split()
            if i % 2:
                for k in range(3, len(passage) - 1, 6):
                    passage[k] = "zz" + word()
            at = R.randrange(0, len(text) + 1)
            text[at:at] = [w.upper() if i % 4 else w + "," for w in passage]
            want[i] = item
        rows.append((i, " ".join(text)))
    return rows, items, want


def plain(rows, items):
    """Every diagonal of every pair, all stretches."""
    tok = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = set()
    for d, t in rows:
        a = tok(t)
        for i, u in items:
            b = tok(u)
            if not b:
                continue
            for diagonal in range(-len(b) + 1, len(a)):
                lo, hi = max(0, diagonal), min(len(a), diagonal + len(b))
                if hi - lo < min(MIN_TOKENS, len(b)):
                    continue
                equal = [a[k] == b[k - diagonal] for k in range(lo, hi)]
                if sum(equal) < min(6, len(b)):
                    continue
                best, at, start, total = 0, (0, 0), 0, 0
                for k, e in enumerate(equal):
                    if total <= 0:
                        start, total = k, 0
                    total += 1 if e else -2
                    if total > best:
                        best, at = total, (start, k + 1)
                n = at[1] - at[0]
                if n >= min(MIN_TOKENS, len(b)) and sum(equal[at[0] : at[1]]) >= MIN_SHARE * n:
                    out.add((d, i))
    return out


def test_against_all_diagonals(spark, monkeypatch):
    rows, items, want = data()
    rows += [(900, None), (901, ""), (902, "one two"), (903, "it is too, short at all"), (904, rows[0][1]), (904, rows[0][1])]
    items += [(78, "too short"), (79, None), (80, "?!")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, items[0][1])], "item_id long, text string")
    every, long = plain(rows, items), {d for d, i in plain(rows, [x for x in items if x[0] != 78])}
    for bits, most in ((25, 500_000), (8, 0)):  # a bitmap that lets nearly all pass and the shuffled join, too
        monkeypatch.setattr(decontaminate, "BITMAP_BITS", bits)
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
        found = overlaps(docs, bench).collect()
        got = {(r.doc_id, r.item_id) for r in found}
        assert got == every and (903, 78) in got
        assert {(k, v) for k, v in want.items()} <= got and len(found) == len(got) + sum(k == 904 for k, _ in got)
        kept = without_leaks(docs, bench)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in rows if k not in long)
    assert overlaps(docs.limit(0), bench).count() == 0 and overlaps(docs, bench.limit(0)).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == docs.count()
