"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary identifiers, words and numbers, both from labelled samples:
generated ones, and runs of a bounded sample of the documents themselves. These are secret where a fixed pattern matches and
ordinary where they are words in one case or figures, or recur in several documents; other runs are no samples. A run of token characters is a secret if the random model explains it better by more than a prior
in nats, chosen on ordinary runs that the models did not learn from. Spans of the fixed patterns always stay; a model's
span is added where it overlaps none of them.

Defined cases: null text counts as empty (no spans); repeated rows and null ids are rows like any other; an empty table
gives an empty result; other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import kernels
from quire.llm.arrow import lean

#: The patterns that are always secrets, in the order of their kinds.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
_HINT = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=]"

#: Runs that the models judge: at least RUN characters of a token's alphabet, judged without punctuation at their ends.
RUN = 8
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % RUN)
_PART = re.compile(r"[A-Za-z0-9+]{%d,}" % RUN)
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_INDEX = {c: i + 1 for i, c in enumerate(_SYMBOLS)}

#: Nats by which the random model must lead, the prior odds of ordinary runs against secrets: the least, and the most that
#: is chosen on held-out ordinary runs, of which RARE hundred-thousandths may be above it.
PRIOR_NATS, MOST_NATS, RARE = 11.0, 18.0, 2

#: Documents whose runs the models learn from, at most about; runs of one document, and characters of a run, at most.
SAMPLE_DOCS, SAMPLE_RUNS, SAMPLE_CHARS = 3000, 128, 64
#: Documents of the sample in which any run counts as ordinary; runs that are words in one case, or figures.
RECURS = 3
_ORDINARY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_.=-]+(?:[A-Z]?[a-z]+|[A-Z]+))*|[0-9+/_.=-]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, spans array<struct<kind:string,start:long,end:long,nats:double>>"


class MarkovPair:
    """Second-order character models of two classes, each mixed with its lower orders."""

    def __init__(self, samples: list[str], labels: list[int]):
        """Trained from labelled strings: label 1 is random, 0 ordinary."""
        n = len(_SYMBOLS) + 1
        logs = []
        for label in (0, 1):
            one, two, three = np.full(n, 0.1), np.zeros((n, n)), np.zeros((n, n, n))
            for s, y in zip(samples, labels, strict=True):
                if y == label:
                    x = self.codes(s)
                    np.add.at(one, x[2:], 1)
                    np.add.at(two, (x[1:-1], x[2:]), 1)
                    np.add.at(three, (x[:-2], x[1:-1], x[2:]), 1)
            p1 = one / one.sum()
            p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
            p3 = (three + 8 * p2) / (three.sum(2, keepdims=True) + 8)
            logs.append(np.log(p3))
        self.ratio = logs[1] - logs[0]

    @staticmethod
    def codes(s: str) -> np.ndarray:
        return np.array([0, 0, *(_INDEX[c] for c in s if c in _INDEX)])

    def nats(self, s: str) -> float:
        """Log-likelihood ratio of random against ordinary."""
        x = self.codes(s)
        return float(self.ratio[x[:-2], x[1:-1], x[2:]].sum())

    def prior(self, ordinary: list[str]) -> float:
        """Nats above which hardly any of these ordinary strings lies, within the stated bounds."""
        if not ordinary:
            return PRIOR_NATS
        return float(np.clip(np.quantile([self.nats(s) for s in ordinary], 1 - RARE / 1e5) + 1, PRIOR_NATS, MOST_NATS))


#: Ordinary words from which labelled identifiers are composed.
_WORDS = """account action address alpha amount array attribute average balance base batch benchmark block board body book border boundary branch buffer
build bundle button cache calendar call campaign category channel chapter character check child class client cluster code collection color column command
comment commit company component config connection constant container content context control cookie copy core count country course cursor customer
data database date debug decision default definition delay delete department description detail device dialog dictionary directory discount display
document domain download driver edge editor element email engine entity entry error event example exception export expression feature field file filter
folder font footer form format frame function gateway general global graph group handler hash header height history hour icon identifier image import
index information input instance integer interface internal invoice item iterator journal keyboard label language layout letter level library license
limit line link list listener loader local location logger machine manager market master matrix member memory menu message method metric minute model
module monitor month name network node notification number object offset operation option order output package page panel parameter parser password path
pattern payment percent person phone picture pixel place platform player point policy position price primary process product profile program project
property protocol provider query queue range reader record reference region register release remote report request resource response result review
role route schema screen script search second secret section sector selection sender sequence server service session setting shadow shape share signal
simple size source space spark special stage standard start state station status storage store stream string style subject summary support surface
symbol system table target task template term test text theme thread ticket time title token topic total track traffic transaction transfer tree
trigger type unit update upload user utility validation value variable vector version view visitor volume warning week weight widget width window worker year
aber auch beispiel durch einheit entwicklung erfahrung freiheit gesellschaft verantwortung wissenschaft zusammenarbeit avec beaucoup développement
gouvernement maintenant nouvelle toujours ahora conocimiento desarrollo entonces gobierno información siempre universidad""".split()


def labelled_samples(each: int = 4000, seed: int = 5) -> tuple[list[str], list[int]]:
    """``each`` random strings (hex, base-62, base-64, key-like; label 1) and as many identifiers, paths, words and numbers (label 0)."""
    rng = np.random.default_rng(seed)
    pools = ["0123456789abcdef", _SYMBOLS[:62], _SYMBOLS[:64], _SYMBOLS[:26] + _SYMBOLS[52:62], _SYMBOLS[26:62], _SYMBOLS[:62] + "_-"]
    random = ["".join(rng.choice(list(pools[i % len(pools)]), rng.integers(10, 65))) for i in range(each)]
    words, made = [w.encode("ascii", "ignore").decode() for w in _WORDS], []
    parts = sorted({w[i : i + k] for w in words for k in (2, 3, 4) for i in range(0, len(w) - k + 1, k)})
    for i in range(each):
        w = [str(x) for x in rng.choice(words, rng.integers(2, 6))]
        style = i % 12
        if style == 0:
            s = w[0] + "".join(x.title() for x in w[1:])
        elif style == 1:
            s = "".join(x.title() for x in w)
        elif style in (2, 3):
            s = ("_" if style == 2 else "-").join(w)
        elif style == 4:
            s = "_".join(w).upper()
        elif style == 5:
            s = ".".join(w)
        elif style == 6:
            s = "/".join(w) + f".{w[0][:3]}"
        elif style == 7:
            s = "".join(w)
        elif style in (8, 9):  # words of languages unknown here: pieces of words in any order
            s = "".join(map(str, rng.choice(parts, rng.integers(5, 10))))
            s = s.title() if style == 9 else s
        elif style == 10:  # numbers: accounts, cards, telephones
            made.append("".join(map(str, rng.integers(0, 10, rng.integers(8, 40)))))
            continue
        else:
            s = f"{'-'.join(w[:2])}-{rng.integers(1, 32)}-{rng.integers(1990, 2030)}"
        made.append(s + (str(rng.integers(0, 1000)) if i % 4 == 0 else ""))
    filler = [*(c * 30 for c in _SYMBOLS), "1234567890" * 2, "abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "-=" * 12, "+-" * 12] * (each // 400)
    return random + made + filler, [1] * each + [0] * (each + len(filler))


@functools.lru_cache(maxsize=1)
def default_models() -> MarkovPair:
    return MarkovPair(*labelled_samples())


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Spans of the fixed patterns, in order of start, then kind."""
    out = [("assign", *m.span(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", *m.span(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span(), 0.0) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_spans(text: str, models: MarkovPair, prior: float = PRIOR_NATS) -> list[tuple[str, int, int, float]]:
    """All spans of a text, in order of start, then kind."""
    base = base_spans(text)
    out = list(base)
    for m in _RUN.finditer(text):
        run = m[0].strip("/_.-+")
        start = m.start() + m[0].index(run)
        end = start + len(run)
        if len(run) < RUN:
            continue
        # the whole run, else its parts: ordinary characters before a key outweigh it in the sum
        nats = models.nats(run)
        judged = [(start, end, nats)] if nats > prior else [(start + p.start(), start + p.end(), models.nats(p[0])) for p in _PART.finditer(run) if p[0] != run]
        out += [("markov", i, j, nats) for i, j, nats in judged if nats > prior and not any(s < j and i < e for _, s, e, _ in base)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_CODE = np.zeros(256, np.uint8)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(1, len(_SYMBOLS) + 1)
_PART_CODE = np.where(_CODE <= _INDEX["+"], _CODE, 0)
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "/_.-+"]] = True


def _bounds(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, which also end at ``cuts``."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[cuts] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


def _leads(data: np.ndarray, cuts: np.ndarray, models: MarkovPair, prior: float) -> np.ndarray:
    """Positions of runs, or parts of runs, that the random model explains better by ``prior`` nats, and of long runs.

    ``cuts`` are the offsets of texts. The sums are those of :meth:`MarkovPair.nats`, by differences of one running sum.
    """
    code = _CODE[data]
    n = len(code)
    if n < RUN:
        return np.zeros(0, np.int64)
    gain = np.zeros(n)
    gain[2:] = models.ratio[code[:-2], code[1:-1], code[2:]]
    total = np.concatenate([[0.0], np.cumsum(gain)])
    out = []
    starts, ends = _bounds(code > 0, cuts)
    out.append(starts[ends - starts >= 20])  # the shortest run of the access and hex patterns
    solid = np.flatnonzero(~_EDGE[data])
    if len(solid):  # punctuation at the ends is not judged
        at = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        some = at[0] <= at[1]
        starts, ends = solid[np.minimum(at[0], len(solid) - 1)][some], solid[np.maximum(at[1], 0)][some] + 1
        for a, b in ((starts, ends), _bounds(_PART_CODE[data] > 0, cuts)):
            long = b - a >= RUN
            a, b = a[long], b[long]
            c0, c1 = code[a], code[np.minimum(a + 1, n - 1)]
            nats = total[b] - total[a + 2] + models.ratio[0, 0, c0] + models.ratio[0, c0, c1]
            out.append(a[nats > prior - 1e-3])
    return np.concatenate(out)


def _suspects(column: pa.Array, models: MarkovPair, prior: float) -> np.ndarray:
    """Rows that can have a span: a keyword with its sign, or a run that :func:`_leads` names."""
    hint = np.asarray(pc.match_substring_regex(column, _HINT).fill_null(False).cast(pa.uint8())).astype(bool)
    data, offsets = kernels.strings(column)
    for i, j in kernels.slices(offsets, kernels.BLOCK):
        lo, end = int(offsets[i]), int(offsets[j])
        while lo < end:  # a long text in blocks that end between runs
            hi = min(end, lo + kernels.BLOCK)
            while hi < end and _CODE[data[hi - 1]]:
                gap = np.flatnonzero(_CODE[data[hi : hi + kernels.BLOCK]] == 0)
                hi = min(end, hi + (int(gap[0]) + 1 if len(gap) else kernels.BLOCK))
            cuts = offsets[i : j + 1]
            found = lo + _leads(data[lo:hi], cuts[(cuts >= lo) & (cuts <= hi)] - lo, models, prior)
            hint[np.searchsorted(offsets, found, "right") - 1] = True
            lo = hi
    return hint


def _labelled_runs(text: str) -> list[tuple[str, int]]:
    """Runs of a text with label 1 where a fixed pattern has them, else 0; of many, those with the least hashes."""
    base = base_spans(text)
    out = {(m[0][:SAMPLE_CHARS], int(any(s < m.end() and m.start() < e for _, s, e, _ in base))) for m in _RUN.finditer(text)}
    return sorted(out, key=lambda x: zlib.crc32(x[0].encode()))[:SAMPLE_RUNS]


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[MarkovPair, float]:
    """Models and prior from generated samples and from the runs of about ``SAMPLE_DOCS`` documents, chosen by a hash."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for t in b.column(0) for x in _labelled_runs(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], names=["run", "label"])

    some = docs.where(F.pmod(F.xxhash64(F.lit(11), docs[id_col], docs[text_col]), F.lit(1_000_000)) / 1e6 < share)
    # one row for each text that a run is in, whatever copies the text has; at most SAMPLE_RUNS a document
    got = Counter((r[0], r[1]) for r in some.select(docs[text_col]).distinct().mapInArrow(lean(runs), "run string, label int").collect())
    rows = sorted(x for x, n in got.items() if x[1] or n >= RECURS or _ORDINARY.fullmatch(x[0]))
    made, labels = labelled_samples()
    learn = [r for r in rows if zlib.crc32(r[0].encode()) % 5]
    # words in capitals are rare and ordinary: every ordinary word is learned in capitals too
    capitals = [r[0].upper() for r in learn if not r[1] and r[0].isalpha()]
    models = MarkovPair(made + [r[0] for r in learn] + capitals, labels + [r[1] for r in learn] + [0] * len(capitals))
    judged = {p for run, y in rows if not y and not zlib.crc32(run.encode()) % 5 for p in (run.strip("/_.-+"), *_PART.findall(run)) if len(p) >= RUN}
    return models, models.prior(sorted(judged))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None, samples: tuple[list[str], list[int]] | None = None) -> DataFrame:
    """Spans and counts per document; ``samples`` are labelled strings to train the models from, without any of the documents'."""
    models, chosen = fit(docs, text_col, id_col) if samples is None else (MarkovPair(*samples), PRIOR_NATS)
    shared = docs.sparkSession.sparkContext.broadcast((models, chosen if prior is None else prior))  # fixed size: 70 cubed weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("nats", pa.float64())]))
        for b in batches:
            texts = b.column(1)
            found = [find_spans(texts[i].as_py() or "", *shared.value) if hit else [] for i, hit in enumerate(_suspects(texts, *shared.value).tolist())]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
            spans = pa.array([[dict(zip(("kind", "start", "end", "nats"), s, strict=True)) for s in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *counts, spans], names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "spans"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(scan), SCHEMA)
