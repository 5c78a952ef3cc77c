"""Every stage of the pipeline against brute force, on rows with nulls, empty texts, repeated rows and clashing column names."""

import random
import zlib

import pytest

import corpus_pipeline
from tessera.llm.toxicity import SEED_WORDS
from tests.llm import test_decontaminate, test_near_dup
from tests.llm.test_tokens import expected

#: Names that operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, hits string, component_id long, kept string, predicted int, id long"
STAGES = dict(corpus_pipeline.STAGES)


def words(r, n):
    return ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(n)]


def texts():
    r = random.Random(9)
    passage, question, base = words(r, 70), words(r, 30), words(r, 150)
    rows = [(k, " ".join(words(r, r.randrange(5, 160)))) for k in range(40)]
    rows += [(100 + k, " ".join([*words(r, 30), *passage, *words(r, 30)])) for k in range(3)]
    rows += [(200 + k, " ".join([*words(r, 20), *question, *words(r, 20)])) for k in range(2)]
    for k in range(4):
        own = list(base)
        own[10 + k] = "other"
        rows.append((300 + k, " ".join(own)))
    rows += [(400, rows[0][1]), (7, rows[7][1]), (None, "without an id " + rows[1][1]), (500, None), (501, ""), (502, " \n "), (503, "one two three")]
    return rows, [(1, " ".join(question)), (2, None), (3, "short one")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items = texts()
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "a", "b", "c", 5, "d", 1, 9) for k, t in rows], CLASHING)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, items, docs, folder


def kept(spark, tables, name, docs=None):
    rows, _, own, folder = tables
    out = STAGES[name](spark, own if docs is None else docs, folder)
    if name != "packing":
        assert out.schema.simpleString() == own.schema.simpleString()
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_toxicity_stage(spark, tables):
    """Without labels the seed words decide; clean rows stay, whatever their columns hold."""
    rows, _, docs, _ = tables
    bad = spark.createDataFrame([(900, " ".join(["you", next(iter(SEED_WORDS))] * 8), *docs.first()[2:])], CLASHING)
    got = kept(spark, tables, "toxicity", docs.union(bad))
    assert got == sorted(rows, key=str)


def test_near_duplicate_stage(spark, tables):
    rows = tables[0]
    stays = {(k, t) for k, t in rows if k is None}
    named = [(k, t) for k, t in rows if k is not None]
    keep = {k for k, _, _, own in test_near_dup.plain(list(dict(named).items()), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT) if own}
    want = sorted([(k, t) for k, t in named if k in keep] + list(stays), key=str)
    assert kept(spark, tables, "near_duplicates") == want and 400 not in keep and not {301, 302, 303} & keep


def test_repeat_stage(spark, tables):
    length, rows = corpus_pipeline.REPEAT_BYTES, tables[0]
    data = [(k, (t or "").encode()) for k, t in rows]
    seen: dict = {}
    for _, t in data:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    want = []
    for k, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        want.append((k, bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")))
    assert kept(spark, tables, "repeats") == sorted(want, key=str) and any(len(a[1]) < len((b[1] or "").encode()) for a, b in zip(want, rows, strict=True))


def test_decontamination_stage(spark, tables):
    rows, items = tables[:2]
    leaks = {d for d, _ in test_decontaminate.plain([(k, t) for k, t in enumerate(t for _, t in rows)], [i for i in items if i[0] == 1])}
    assert kept(spark, tables, "decontamination") == sorted(((k, t) for n, (k, t) in enumerate(rows) if n not in leaks), key=str) and len(leaks) == 2


def test_packing_stage(spark, tables):
    rows, _, docs, folder = tables
    got = STAGES["packing"](spark, docs, folder).collect()
    window = corpus_pipeline.WINDOW
    want = []
    for k, t in rows:
        ids = expected(t, corpus_pipeline.END_ID)
        want += [(k, s, len(ids[s : s + window]), zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[s : s + window])), len(ids)) for s in range(0, len(ids), window)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, tables, name):
    assert STAGES[name](spark, tables[2].limit(0), tables[3]).count() == 0


def test_run(spark, tables):
    """All stages one after another: what is packed are the ids of documents that every stage kept."""
    got = {r.doc_id for r in corpus_pipeline.run(spark, tables[3]).collect()}
    ids = {k for k, _ in tables[0]}
    assert got <= ids and not got & {200, 201, 301, 302, 303, 400} and {1, 2, 300, 500, 501} <= got
