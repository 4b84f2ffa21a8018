"""Document quality from a linear-chain conditional random field over lines.

Every line gets bins of its own features and of its neighbours'; the field labels lines good or bad, and a document's
quality is the length-weighted mean of its lines' forward-backward marginals, calibrated to a probability on the same
labelled documents.

Defined cases: null and empty texts, and texts of white space alone, get the share of good documents among those learned
from; repeated rows and null ids are rows like any other; an empty table gives an empty result; with nothing to learn
from every score is 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import kernels
from quire.llm.arrow import lean
from quire.llm.crf import LinearChain
from quire.llm.folds import SAMPLE_EACH, sample

SCHEMA = "doc_id long, score double, n_lines long, n_bad_lines long"

_CLASS = np.zeros(256, np.uint8)  # 1 lower letter, 2 upper letter, 3 digit, 4 usual punctuation, 5 other symbol, 6 space
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?()-/"]] = 4
_CLASS[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = 5
_CLASS[[32, *range(9, 14)]] = 6

#: Bin edges of each line feature.
EDGES = {
    "length": (1, 20, 60, 150, 400, 1000),
    "upper": (0.02, 0.08, 0.2, 0.5),
    "digit": (0.01, 0.05, 0.2, 0.5),
    "punctuation": (0.01, 0.03, 0.06, 0.12, 0.25),
    "symbol": (0.003, 0.02, 0.06, 0.15),
    "symbol words": (0.02, 0.1, 0.3),
    "same as word before": (0.02, 0.08, 0.2, 0.5),
    "same as two words before": (0.03, 0.1, 0.25, 0.5),
    "word length": (2.5, 4, 5.5, 7, 10),
    "line seen before": (0.5,),
    "ends as a sentence": (0.5,),
}
_WIDTH = 8  # bins kept for each feature
_NEIGHBOURS = ("symbol", "upper", "symbol words", "same as word before", "line seen before", "length")


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each non-blank line's features, its bytes, lines per text)."""
    n_docs, size = len(offsets) - 1, len(data)
    cls = _CLASS[data]
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    starts, ends = breaks[:-1], breaks[1:]
    if not len(starts):
        return np.zeros((0, len(EDGES) + 2 * len(_NEIGHBOURS)), np.int64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    per = {k: np.add.reduceat((cls == k).astype(np.int32), starts) for k in range(1, 7)}
    length = (ends - starts) - per[6]
    hashes, counts, heads = kernels.words(data, offsets)
    line_of = np.searchsorted(starts, heads, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts))
    same = [np.bincount(line_of[k:][(hashes[k:] == hashes[:-k]) & (line_of[k:] == line_of[:-k])], minlength=len(starts)) for k in (1, 2)]
    plain = np.concatenate([[0], np.cumsum(cls <= 3)])
    word_ends = np.concatenate([heads[1:], [size]]) if len(heads) else heads
    marks = np.bincount(line_of[plain[word_ends] == plain[heads]], minlength=len(starts)) if len(heads) else np.zeros(len(starts), int)
    with np.errstate(over="ignore"):
        spun = hashes * (np.arange(len(hashes), dtype=np.uint64) - np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.uint64)[line_of] + np.uint64(1)) if len(heads) else hashes
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spun)])
        edge = np.concatenate([[0], np.cumsum(n_words)])
        line_hash = total[edge[1:]] - total[edge[:-1]]
    doc_of = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((starts, line_hash, doc_of))
    seen = np.zeros(len(starts), bool)
    seen[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (doc_of[order[1:]] == doc_of[order[:-1]]) & (n_words[order[1:]] > 0)
    last = np.maximum.reduceat(np.where(cls != 6, np.arange(size), -1), starts)
    stops = np.isin(data[np.maximum(last, 0)], np.frombuffer(b".!?:;\"')", np.uint8))
    chars, words_ = np.maximum(length, 1), np.maximum(n_words, 1)
    values = {
        "length": length,
        "upper": per[2] / chars,
        "digit": per[3] / chars,
        "punctuation": per[4] / chars,
        "symbol": per[5] / chars,
        "symbol words": marks / words_,
        "same as word before": same[0] / words_,
        "same as two words before": same[1] / words_,
        "word length": (per[1] + per[2]) / words_,
        "line seen before": seen,
        "ends as a sentence": stops,
    }
    keep = length > 0
    per_doc = np.bincount(doc_of[keep], minlength=n_docs)
    own = {k: np.searchsorted(EDGES[k], v[keep], "right") for k, v in values.items()}
    return _with_neighbours(own, per_doc), length[keep], per_doc


def _with_neighbours(own: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Bin numbers of each line's features, then of the line before and behind (a bin of their own at the ends)."""
    n = len(next(iter(own.values())))
    columns = list(own.values())
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    for k in _NEIGHBOURS:
        before, behind = np.full(n, _WIDTH - 1), np.full(n, _WIDTH - 1)
        before[1:], behind[:-1] = own[k][:-1], own[k][1:]
        before[starts] = _WIDTH - 1
        behind[(starts - 1)[1:] if len(starts) else starts] = _WIDTH - 1
        columns += [before, behind]
    return np.stack(columns, 1) + _WIDTH * np.arange(len(columns))


class QualityModel:
    """The field and the calibration from mean marginals to a document's probability."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.prior = float(np.clip(np.mean(labels), 0.01, 0.99)) if labels else 0.5
        self.chain = LinearChain(_WIDTH * (len(EDGES) + 2 * len(_NEIGHBOURS)))
        self.fitted = len(set(labels)) == 2
        if not self.fitted:
            return
        data, offsets = kernels.strings(pa.array(texts, pa.large_string()))
        parts = [lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in kernels.slices(offsets)]
        features, weight, per_doc = (np.concatenate([p[k] for p in parts]) for k in range(3))
        y = np.asarray(labels, np.int64)
        line_y = np.repeat(y, per_doc)
        # lines of bad documents that look good on their own are good: a first field without chains tells which
        alone = LinearChain(len(self.chain.w)).fit(features, line_y, np.ones(len(line_y), np.int64), steps=60)
        emit = alone.scores(features) + alone.start
        line_y = np.where((line_y == 0) & (emit[:, 1] - emit[:, 0] > 1.0), 1, line_y)
        self.chain.fit(features, line_y, per_doc, steps=80)
        x = self._mean(features, weight, per_doc)[0]
        filled = per_doc > 0
        self.curve = _logistic(_shape(x[filled]), y[filled])

    def _mean(self, features: np.ndarray, weight: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marginal, _, _ = self.chain.forward_backward(self.chain.scores(features), per_doc)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        good = np.bincount(doc, weight * marginal[:, 1], len(per_doc)) / np.maximum(np.bincount(doc, weight, len(per_doc)), 1)
        return good, np.bincount(doc, marginal[:, 1] < 0.5, len(per_doc)).astype(np.int64)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good, lines, bad lines) of each text."""
        features, weight, per_doc = lines(data, offsets)
        if not self.fitted:
            return np.full(len(per_doc), self.prior), per_doc, np.zeros(len(per_doc), np.int64)
        good, bad = self._mean(features, weight, per_doc)
        p = 1 / (1 + np.exp(-_shape(good) @ self.curve))
        return np.where(per_doc > 0, p, self.prior), per_doc, bad


def _shape(good: np.ndarray) -> np.ndarray:
    """What the calibration sees of a mean marginal: its log-odds, itself, and a constant."""
    p = np.clip(good, 1e-4, 1 - 1e-4)
    return np.stack([np.log(p / (1 - p)), 4 * p, np.ones_like(p)], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w), -2, 2)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = SAMPLE_EACH) -> QualityModel:
    """Learned from about ``each`` documents of both labels outside the held-out fold."""
    chosen = sample(labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")), "_id", "_y", each)
    # about twice ``each`` ids whatever the table's size
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_text", "_y").collect()
    return QualityModel([r[0] or "" for r in rows], [int(r[1]) for r in rows])


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, lines and bad lines of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: a few thousand weights

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offsets = kernels.strings(b.column(1))
            got = [m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in kernels.slices(offsets, kernels.BLOCK)]
            score, n, bad = ([np.concatenate([g[k] for g in got]) for k in range(3)]) if got else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(score), pa.array(n.astype(np.int64)), pa.array(bad)], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(predict), SCHEMA)
