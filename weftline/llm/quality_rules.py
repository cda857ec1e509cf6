"""Quality rules: base rules and gradient-boosted trees over document statistics.

The statistics of every document come from one Arrow pass. Trees are grown with numpy on a bounded, hashed sample of
labelled rows (``SAMPLE_ROWS``; the bound on the hash comes from the number of labels, so what is broadcast and what comes to
the driver stays of that size), with monotonic constraints on the features in ``FALLING``: more symbols, repeats or
capitals never raise a score. The trees are flattened into node arrays and scored for whole batches at once.

Defined results: a null or empty text has no words and fails the base rules; a null doc_id is kept as a row with a null
id; repeated rows are judged one by one; without usable labels of both classes every document passes the trees; extra
columns of ``documents`` are ignored (``document_statistics``) or passed through (``keep_documents``). A score equal to
``THRESHOLD`` passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, own_columns, staged, table
from weftline.llm.textarrays import U64, Texts, gram_hashes, mixed, span_hashes

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 40, 3, 64, 0.2, 1.0, 20
THRESHOLD = 0.5
MIN_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_unique_words", "n_capitals", "n_digits", "n_stops")
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "unique", "capitals", "digits", "stops", "lines")
FALLING = ("symbols", "dup_lines", "repeats", "capitals")

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CAPITALS = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
DIGITS = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
FOLLOWING = (np.arange(256) & 0xC0) == 0x80  # a UTF-8 byte that begins no code point


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is there twice or more, and whether it stood at an earlier place."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    as_before = np.concatenate(([False], ranked[1:] == ranked[:-1])) if len(keys) else np.zeros(0, bool)
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = as_before
    twice[order] = as_before | np.concatenate((as_before[1:], [False])) if len(keys) else as_before
    return twice, later


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE for every text of a batch."""
    t = Texts(texts)
    in_word = np.zeros(len(t.data) + 1, np.int8)
    in_word[t.starts] += 1
    in_word[t.ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).view(bool)
    own = mixed(np.arange(t.n, dtype=U64) + U64(1))
    words = t.word_hashes()

    trigrams = gram_hashes(words, 3)
    at = np.flatnonzero(t.same_text(3))
    twice, _ = _repeated(trigrams[at] ^ own[t.text[at]])
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    _, word_before = _repeated(words ^ own[t.text])

    ends = np.flatnonzero(np.isin(t.data, np.uint8(0x0A)) | np.isin(np.arange(len(t.data)), t.first[1:] - 1))
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if len(ends) else ends
    line_text = np.searchsorted(t.first, starts, side="right") - 1
    with_word = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends, line_text = starts[with_word], ends[with_word], line_text[with_word]
    _, line_before = _repeated(span_hashes(t.data, starts, ends) ^ own[line_text])
    return {
        "n_words": t.n_words,
        "word_chars": t.per_text(in_word & ~FOLLOWING[t.data]),
        "n_symbols": t.per_text(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(line_text[line_before], minlength=t.n),
        "n_repeat_words": t.per_text_words(covered),
        "n_lines": np.bincount(line_text, minlength=t.n),
        "n_unique_words": t.per_text_words(~word_before),
        "n_capitals": t.per_text(CAPITALS[t.data]),
        "n_digits": t.per_text(DIGITS[t.data]),
        "n_stops": t.per_text(STOPS[t.data]),
    }


def feature_matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, so that the length of a text alone decides nothing."""
    n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    by = {
        "mean_word": s["word_chars"] / n, "symbols": s["n_symbols"] / n, "dup_lines": s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        "repeats": s["n_repeat_words"] / n, "unique": s["n_unique_words"] / np.sqrt(n), "capitals": s["n_capitals"] / chars,
        "digits": s["n_digits"] / chars, "stops": s["n_stops"] / n, "lines": s["n_lines"] / n,
    }
    return np.column_stack([by[k] for k in FEATURES]).astype(np.float64)


class Trees:
    """Boosted trees as flat arrays, a row for each tree: feature (-1 at a leaf), cut, left child (right is next), value."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.cut, self.left, self.value, self.start = feature, cut, left, value, start

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, l, v in zip(self.feature, self.cut, self.left, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[node] >= 0
                right = x[rows, np.maximum(f[node], 0)] > c[node]
                node = np.where(inner, l[node] + right, node)
            total += v[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, falling: tuple[str, ...] = FALLING) -> Trees | None:
    """Logistic boosting with histogram splits. None if a class has no rows. A split on a falling feature must give the
    higher side the lower value, and its children stay on their sides of the midpoint, so the whole score is monotonic."""
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    sign = np.array([-1 if name in falling else 0 for name in FEATURES])
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, size = np.full(len(y), start), 2 ** (DEPTH + 1) - 1
    out = [np.full((TREES, size), -1), np.zeros((TREES, size)), np.zeros((TREES, size), np.int64), np.zeros((TREES, size))]
    weight = lambda g, h, low, high: np.clip(g / (h + L2), low, high)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess, used = y - p, p * (1 - p), 1
        open_nodes = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            node, rows, low, high, depth = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            own = float(weight(g, h, low, high))
            gain = lambda a, b, w: a * w - 0.5 * (b + L2) * w * w
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * LEAST else ():
                k, b = len(cuts[j]) + 1, binned[rows, j]
                gl, hl = np.cumsum(np.bincount(b, grad[rows], k))[:-1], np.cumsum(np.bincount(b, hess[rows], k))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
                wl, wr = weight(gl, hl, low, high), weight(g - gl, h - hl, low, high)
                rise = gain(gl, hl, wl) + gain(g - gl, h - hl, wr) - gain(g, h, own)
                fine = (nl >= LEAST) & (len(rows) - nl >= LEAST) & ((wr - wl) * sign[j] >= 0)
                if fine.any() and (top := np.where(fine, rise, -np.inf)).max() > best[0]:
                    at = int(top.argmax())
                    best = (float(top[at]), j, at, float(wl[at]), float(wr[at]))
            _, j, at, wl, wr = best
            if j < 0:
                out[3][tree, node] = RATE * own
                score[rows] += RATE * own
                continue
            out[0][tree, node], out[1][tree, node], out[2][tree, node] = j, cuts[j][at], used
            goes_right, mid = binned[rows, j] > at, (wl + wr) / 2
            bounds = ((low, high), (low, high)) if not sign[j] else ((mid, high), (low, mid))
            for side, bound in zip((rows[~goes_right], rows[goes_right]), bounds, strict=True):
                open_nodes.append((used, side, *bound, depth + 1))
                used += 1
    return Trees(*out, start)


def verdicts(s: dict[str, np.ndarray], trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score and kept."""
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    score = trees.probability(feature_matrix(s)) if trees else np.ones(len(failed))
    return failed, score, ~failed & (score >= THRESHOLD)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(s[k], pa.int64()) for k in COUNTS + MORE]], ["doc_id", *COUNTS, *MORE])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS + MORE))


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and quality of about ``rows`` labels at most: those whose ids' hashes are below a bound that their number sets."""
    seen = own_columns(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").distinct()
    share = min(1.0, rows / max(1, seen.count()))
    return seen.where(F.xxhash64("doc_id") <= min(2**63 - 1, int(share * 2**64) - 2**63))


def fit(stats: DataFrame, sample: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from the statistics of the documents of a sample of labels, ``rows`` of them at most."""
    got = stats.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *COUNTS).limit(rows).toPandas()
    return fit_trees(feature_matrix({k: got[k].to_numpy() for k in COUNTS + MORE}), got["quality"].to_numpy(np.float64))


def _kept(trees: Trees | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdicts(statistics(b.column(b.schema.get_field_index("text"))), trees)[2]))

    return run


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    sample = labelled_sample(labels)
    trees = fit(document_statistics(docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")), sample)
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_kept(trees), docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, score, base_failed and kept for every document."""
    stats = staged(document_statistics(docs), "quality")
    trees = fit(stats, labelled_sample(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = {k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS + MORE}
            failed, score, kept = verdicts(s, trees)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ("doc_id", *COUNTS)], pa.array(score), pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "score", "base_failed", "kept"])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", score double, base_failed boolean, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
