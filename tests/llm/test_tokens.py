import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import cached_bpe
from tessera.llm.packing import CapacityTree, pack, plan_best_fit
from tessera.llm.token_counts import token_counts
from tessera.llm.token_shards import IndexFile, build_index, build_mphf, index_uri, key_hash, mphf_slots, ranked, token_shards_roundtrip

NAME = "byte_bpe_50k.json"
TEXTS = [
    "it's we're I'll 'tis  don't 'd  x's'll 'stuff 'restuff can't\n\n  a \n b  ", "", None, "  ", "a<|endoftext|>b 's", "中文 hello 123abc!? \n", "tab\tx\r\n\r\n y  ", "'s", "''s ' s '",
    "a\xa0b \xa0 c d", "\n'll", "x\n's 12's ...'s é's", "l'l l'lm'm", "\x00\x1c a\x1fb\x85c", "ª²¼ ½x º", "a ", " ", " a", "’s it’s — … “q”", "word " * 5000, "word " * 5000, "same", "same",
]


def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def docs(spark, texts=TEXTS):
    rows = [(i if i != 5 else 4, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard long")


def expected(text, end=None):
    return library().encode(text or "", add_special_tokens=False).ids + ([end] if end is not None else [])


def test_cached_bpe_equals_library():
    for lo, hi, counts, ids in cached_bpe(NAME).encode_column(pa.array(TEXTS, pa.string())):
        want = [expected(t) for t in TEXTS[lo:hi]]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])


def test_token_counts_and_cache(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = sorted((r.doc_id, len((r.text or "").encode()), len(expected(r.text)), len(expected(r.text)) > 512) for r in docs(spark).collect())
    assert sorted(map(tuple, token_counts(docs(spark), NAME, cache).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in TEXTS})
    assert sorted(map(tuple, token_counts(docs(spark), NAME, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored
    assert token_counts(docs(spark, []), NAME).count() == 0


def test_shards_roundtrip(spark):
    got = sorted(map(tuple, token_shards_roundtrip(docs(spark), NAME, 2).collect()))
    rows = sorted(((r.doc_id, r.text or "") for r in docs(spark).collect()))
    want, at = [], 0
    for key, text in rows:
        ids = expected(text, 2)
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_shards_roundtrip(docs(spark, []), NAME, 2).count() == 0


def test_mphf_is_minimal_and_perfect():
    h = key_hash(np.arange(20_000) * 7 - 5)
    levels = ranked(build_mphf(h))
    assert sorted(mphf_slots(levels, h).tolist()) == list(range(20_000))


def test_index_file(spark, tmp_path):
    """One key at a time and all at once give the same entries; keys that are not there are not found."""
    path = f"file://{tmp_path}"
    manifest = spark.createDataFrame([(k * 3 - 40, k % 5, k // 5, 1) for k in range(3000)] + [(None, 9, 9, 1)], "doc_id long, shard int, ordinal long, n_tokens long")
    assert build_index(manifest, path) == 1
    index = IndexFile(index_uri(path, 0))
    assert index.entries == 3000
    ok, found = index.find(np.arange(3000) * 3 - 40)
    assert ok.all() and [(e["shard"], e["first"], e["copies"]) for e in found] == [(k % 5, k // 5, 1) for k in range(3000)]
    for k in (0, 7, 2999):
        assert (index.get(k * 3 - 40)["shard"], index.get(k * 3 - 40)["first"]) == (k % 5, k // 5)
    assert index.get(1) is None and not index.find(np.array([1, 3, 4]))[0].any()


def test_tree_finds_tightest():
    tree = CapacityTree(16)
    for c in (3, 9, 12):
        tree.add(c, 1)
    assert [tree.tightest(x) for x in (1, 4, 9, 10, 13)] == [3, 9, 9, 12, -1]


def plain_best_fit(lengths, window):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        b = min(fit, key=lambda b: b[0]) if fit else None
        if b is None:
            bins.append(b := [window])
        b[0] -= x
    return sorted(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    lengths = np.random.default_rng(seed).integers(1, 64, 300)
    values, n = np.unique(lengths, return_counts=True)
    plan, bins = plan_best_fit(dict(zip(values.tolist(), n.tolist(), strict=True)), 64)
    left = [64] * bins
    for value, count in zip(values.tolist(), n.tolist(), strict=True):
        own = [p for p in plan if p[0] == value]
        for r in range(count):
            s = max((p for p in own if p[1] <= r), key=lambda p: p[1])
            left[s[2] + (r - s[1]) // s[3]] -= value
    assert sorted(left) == plain_best_fit(lengths.tolist(), 64)


def test_pack(spark):
    got = pack(docs(spark), NAME, 1, 64).collect()
    by, rows = {}, sorted((r.doc_id, tuple(expected(r.text, 1))) for r in docs(spark).collect())
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    pieces = sorted((k, s, min(64, len(ids) - s), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()), len(ids)) for k, ids in rows for s in range(0, len(ids), 64))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == pieces
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert pack(docs(spark, []), NAME, 1).count() == 0
