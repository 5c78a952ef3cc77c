"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features are densities of a learned lexicon (whole words and word beginnings), its proximity to second-person
words, capitals, punctuation and obfuscation rates. Lexicon, trees and calibration are learned from a bounded sample
of labelled rows (``SAMPLE_ROWS``); every document is scored on its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import lower_ascii, prefix_hash, range_hash, text_chunks
from .storage import bounded_batches, written

#: Labelled rows that lexicon, trees and calibration are fitted on at most (those with the smallest hash of their id).
SAMPLE_ROWS = 20_000
#: Word beginnings, in bytes, that can stand in the lexicon beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Entries of the lexicon at most: the bound of what is sent to executors.
LEXICON_ENTRIES = 20_000
#: Share of toxic sample documents (and least number) that must hold a lexicon entry.
MIN_SHARE, MIN_DOCS = 0.003, 4

# Second-person words in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú usted ustedes vosotros ti tuyo tus".split()
# Insults that are in the lexicon whatever the sample holds.
SEED_WORDS = "idiot moron stupid pathetic scum loser trash worthless disgusting clown dumb idiotic imbecile fool jerk".split()
FEATURES = ("strong_per_word", "strong_count", "mild_per_word", "near_second_person", "second_person_per_word", "capitals", "capital_words", "exclamations", "punctuation", "obfuscation", "digits", "mean_word", "log_words")

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_MASKING = np.zeros(256, bool)
_MASKING[[ord(c) for c in "*@$#%&_+0123456789!"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(range_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def _letter_words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, first word of each row) of maximal letter runs."""
    low = lower_ascii(data)
    inside = _LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    return low, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def _keys(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yields (hash, which word) of whole words and of their proper beginnings; a beginning never equals a word's key."""
    yield range_hash(prefix, starts, ends), np.arange(len(starts))
    for k in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > k)
        yield range_hash(prefix, starts[longer], starts[longer] + k) + np.uint64(k), longer


class _Members:
    """Set of hashes with a fast first test on 16 bits."""

    def __init__(self, hashes):
        self.sorted = np.sort(np.array(hashes, np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
        if len(self.sorted):
            some = np.flatnonzero(out)
            i = np.minimum(np.searchsorted(self.sorted, h[some]), len(self.sorted) - 1)
            out[some] = self.sorted[i] == h[some]
        return out


def features(data: np.ndarray, offsets: np.ndarray, strong: _Members, mild: _Members, second: _Members) -> np.ndarray:
    """Feature matrix (rows x FEATURES) of texts data[offsets[i]:offsets[i+1]]; an empty text has zeros."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    if not len(data):
        return out
    low, starts, ends, first = _letter_words(data, offsets)
    n_words, size = np.diff(first), np.diff(offsets)

    def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    prefix = prefix_hash(low)
    hits, weak, you = (np.zeros(len(starts), bool) for _ in range(3))
    for k, (h, which) in enumerate(_keys(prefix, starts, ends)):
        hits[which[strong(h)]] = True
        weak[which[mild(h)]] = True
        if not k:
            you = second(h)
    near = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(you)
    np.add.at(near, np.maximum(at - 3, 0), 1)
    np.add.at(near, np.minimum(at + 4, len(starts)), -1)
    close = hits & (np.cumsum(near)[:-1] > 0)
    upper = _UPPER[data]
    capital = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    shouting = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 1)
    letters = _LETTER[low]
    masked = np.zeros(len(low), bool)
    if len(low) > 2:
        masked[1:-1] = _MASKING[data[1:-1]] & letters[:-2] & letters[2:]
    words, chars = np.maximum(n_words, 1), np.maximum(size, 1)
    strong_n = per_row(hits, first)
    columns = (
        strong_n / words, strong_n, per_row(weak, first) / words, per_row(close, first) / words, per_row(you, first) / words, per_row(upper, offsets) / chars, per_row(shouting, first) / words,
        per_row(data == 33, offsets) / chars, per_row(_PUNCT[data], offsets) / chars, per_row(masked, offsets) / words, per_row(_DIGIT[data], offsets) / chars, per_row(letters, offsets) / words, np.log1p(n_words),
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


# -- gradient-boosted trees ----------------------------------------------------------------------------------------
class BoostedTrees:
    """Logistic boosting with histogram splits over at most 64 bins a feature; complete trees of a fixed depth."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.smooth, self.least = rounds, depth, rate, smooth, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64))) for j in range(m)]
        bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin <= k means x <= cuts[k]
        width = 65
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-9)
                chosen = np.full(count, -1)
                at = np.zeros(count, np.int64)
                for j in range(m):
                    where = (node - first) * width + bins[:, j]
                    g = np.cumsum(np.bincount(where, grad, count * width).reshape(count, width), 1)
                    h = np.cumsum(np.bincount(where, hess, count * width).reshape(count, width), 1)
                    gr, hr = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + self.smooth) + gr**2 / (hr + self.smooth) - g[:, -1:] ** 2 / (h[:, -1:] + self.smooth)
                    gain[(h < self.least) | (hr < self.least)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(count), k] > best
                    best[better], chosen[better], at[better] = gain[np.arange(count), k][better], j, k[better]
                for i in np.flatnonzero(chosen >= 0):
                    feature[first + i], cut[first + i] = chosen[i], cuts[chosen[i]][at[i]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + self.smooth)
            self.trees.append((feature, cut, value))
            score = score + value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: (knots, nondecreasing values), for interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, z = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][2] += z
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class ToxicityModel:
    def __init__(self, strong, mild, trees: BoostedTrees, knots: np.ndarray, values: np.ndarray):
        self.strong, self.mild, self.trees, self.knots, self.values = list(map(int, strong)), list(map(int, mild)), trees, knots, values

    def members(self):
        return _Members(self.strong), _Members(self.mild), _Members([_hash_of(w) for w in SECOND_PERSON])

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        """Isotonic probability; a hundredth of the plain probability keeps the order within its steps."""
        plain = 1 / (1 + np.exp(-margin))
        return np.clip(0.99 * np.interp(margin, self.knots, self.values) + 0.01 * plain, 0, 1) if len(self.knots) else plain


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the sample: labelled rows with crc32(doc_id) mod 5 other than 0; conflicting labels count as toxic."""
    usable = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)


def _sample_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE_ROWS ids are broadcast; a repeated doc_id keeps one text (the smallest)."""
    sample = docs.select("doc_id", "text").join(F.broadcast(training_rows(docs, labels)), "doc_id")
    return written(sample.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxicity-sample")


def _count_keys(candidates: np.ndarray | None):
    """Partial document counts of word keys (all, or the candidates only), one row for each key and batch."""
    wanted = None if candidates is None else _Members(candidates)

    def run(batches):
        for batch in batches:
            found = []
            for _, _, data, offsets in text_chunks(batch.column(0)):
                if not len(data):
                    continue
                low, starts, ends, first = _letter_words(data, offsets)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                for h, which in _keys(prefix_hash(low), starts, ends):
                    keep = np.ones(len(h), bool) if wanted is None else wanted(h)
                    pair = np.unique(np.stack([h[keep], row[which[keep]].astype(np.uint64)], 1), axis=0) if keep.any() else np.empty((0, 2), np.uint64)
                    found.append(pair[:, 0])
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from at most SAMPLE_ROWS labelled rows. Without labels of both kinds the seed words alone give the scores."""
    sample = _sample_texts(docs, labels)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    seed = [_hash_of(w) for w in SEED_WORDS]
    if not n_toxic or not n_clean:
        trees = BoostedTrees(rounds=1, depth=1).fit(np.array([[0.0] * len(FEATURES), [1.0] * len(FEATURES)]), np.array([0.0, 1.0]))
        trees.base, trees.trees = -2.0, [(np.array([0]), np.array([0.0]), np.array([0.0, 4.0]))]
        return ToxicityModel(seed, [], trees, np.empty(0), np.empty(0))
    least = max(MIN_DOCS, int(MIN_SHARE * n_toxic))

    def counted(toxic: int, candidates=None) -> DataFrame:
        return sample.where(F.col("toxic") == toxic).select("text").mapInArrow(_count_keys(candidates), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    # Both collections are bounded by the sample: keys in at least MIN_SHARE of its toxic documents.
    hits = {r.key: r.n for r in counted(1).where(F.col("n") >= least).collect()}
    keys = np.array(list(hits), np.int64).view(np.uint64)
    misses = {r.key: r.n for r in counted(0, keys).collect()}
    a, b = np.array(list(hits.values()), float), np.array([misses.get(k, 0) for k in hits], float)
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    order = np.argsort(-odds * np.sqrt(a))
    strong = [int(keys[i]) for i in order if odds[i] > 2.5][:LEXICON_ENTRIES] + seed
    mild = [int(keys[i]) for i in order if 1.0 < odds[i] <= 2.5][:LEXICON_ENTRIES]
    model = ToxicityModel(strong, mild, BoostedTrees(), np.empty(0), np.empty(0))
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(_featurizer(model, ("doc_id", "toxic")), f"doc_id long, toxic int, {', '.join(f'{c} double' for c in FEATURES)}").orderBy("doc_id").toPandas()
    x, y, ids = rows[list(FEATURES)].to_numpy(), rows.toxic.to_numpy().astype(float), rows.doc_id.to_numpy()
    holdout = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(4) == 0
    # A small sample calibrates on all of itself: a part of it would hold too few toxic rows.
    if n_toxic < 400 or holdout.all() or not holdout.any() or y[~holdout].min() == y[~holdout].max():
        holdout = np.zeros(len(y), bool)
    model.trees.fit(x[~holdout], y[~holdout])
    on = holdout if holdout.any() else ~holdout
    model.knots, model.values = isotonic(model.trees.margin(x[on]), y[on])
    return model


def _featurizer(model: ToxicityModel, keep: tuple[str, ...]):
    """Maps batches whose column 1 is the text to the ``keep`` columns and the features."""

    def run(batches):
        sets = model.members()
        for batch in batches:
            names = batch.schema.names
            for lo, hi, data, offsets in text_chunks(batch.column(names.index("text"))):
                part = batch.slice(lo, hi - lo)
                x = features(data, offsets, *sets)
                yield pa.RecordBatch.from_arrays([part.column(names.index(c)) for c in keep] + [pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])], [*keep, *FEATURES])

    return run


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id if none are named) with score and predicted, of every row.

    Null and empty text have all features 0 and get that point's score. Repeated rows stay; row by row, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    keep = keep or ["doc_id"]

    def run(batches):
        sets = model.members()
        for batch in batches:
            names = batch.schema.names
            for lo, hi, data, offsets in text_chunks(batch.column(names.index("__text"))):
                part = batch.slice(lo, hi - lo)
                p = model.calibrated(model.trees.margin(features(data, offsets, *sets)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``. A null doc_id is not held out."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
