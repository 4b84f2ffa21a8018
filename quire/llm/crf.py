"""A linear-chain conditional random field over binned features, trained and decoded with whole-array operations.

Items (lines of a text, blocks of a page) carry a fixed number of small integer features; each (feature, bin) pair has one
weight a label. Sequences of a batch run side by side, so the forward-backward and Viterbi recursions loop over
positions, not over sequences.
"""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Weights (bins, labels) of one-hot features, and transition, start weights."""

    def __init__(self, bins: int, labels: int = 2):
        self.w, self.trans, self.start = np.zeros((bins, labels)), np.zeros((labels, labels)), np.zeros(labels)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Emission scores of items, given each item's bin numbers (items, features)."""
        out = np.zeros((len(features), self.w.shape[1]))
        for j in range(features.shape[1]):
            out += self.w[features[:, j]]
        return out

    @staticmethod
    def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequences by falling length, first item of each, number still running at each position)."""
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        longest = int(lengths.max()) if len(lengths) else 0
        running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
        return order, first, running

    @staticmethod
    def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    def forward_backward(self, emit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(label marginals of items, expected transitions summed, log-partition summed)."""
        n_labels = emit.shape[1]
        order, first, running = self.layout(lengths)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        for t, n in enumerate(running.tolist()):
            at = first[:n] + t
            alpha[at] = emit[at] + (self.start if t == 0 else self._log_sum(alpha[at - 1][:, :, None] + self.trans, 1))
        log_z = np.zeros(len(first))
        for t in range(len(running) - 1, -1, -1):
            n = int(running[t])
            done = 0 if t == len(running) - 1 else int(running[t + 1])
            log_z[done:n] = self._log_sum(alpha[first[done:n] + t], 1)
            at = first[:done] + t
            beta[at] = self._log_sum(self.trans + (emit[at + 1] + beta[at + 1])[:, None, :], 2)
        by_sequence = np.empty(len(lengths))
        by_sequence[order] = log_z
        z = np.repeat(by_sequence, lengths)
        marginal = np.exp(alpha + beta - z[:, None])
        inner = np.ones(len(emit), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        nxt = np.flatnonzero(inner)
        pair = np.exp(alpha[nxt - 1][:, :, None] + self.trans + (emit[nxt] + beta[nxt])[:, None, :] - z[nxt][:, None, None]).sum(0) if len(nxt) else np.zeros((n_labels, n_labels))
        return marginal, pair, float(log_z.sum())

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 150, l2: float = 0.02, rate: float = 0.15) -> "LinearChain":
        """Maximum likelihood with a quadratic penalty, by Adam over the whole sample."""
        keep = lengths > 0
        lengths = lengths[keep]
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(len(labels), bool)
        inner[starts] = False
        nxt = np.flatnonzero(inner)
        seen_w, seen_t, seen_s = np.zeros_like(self.w), np.zeros_like(self.trans), np.zeros_like(self.start)
        for j in range(features.shape[1]):
            np.add.at(seen_w, (features[:, j], labels), 1)
        np.add.at(seen_t, (labels[nxt - 1], labels[nxt]), 1)
        np.add.at(seen_s, labels[starts], 1)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.w, self.trans, self.start)]
        scale = 1 / max(1, len(lengths))
        for step in range(1, steps + 1):
            marginal, pair, _ = self.forward_backward(self.scores(features), lengths)
            want_w = np.zeros_like(self.w)
            for j in range(features.shape[1]):
                for y in range(self.w.shape[1]):
                    want_w[:, y] += np.bincount(features[:, j], marginal[:, y], len(self.w))
            grads = [(seen_w - want_w) * scale - l2 * self.w, (seen_t - pair) * scale - l2 * self.trans, (seen_s - marginal[starts].sum(0)) * scale - l2 * self.start]
            for x, g, (m, v) in zip((self.w, self.trans, self.start), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most probable labels of each sequence, by Viterbi."""
        emit = self.scores(features)
        _, first, running = self.layout(lengths)
        best, back = np.zeros_like(emit), np.zeros(emit.shape, np.int64)
        for t, n in enumerate(running.tolist()):
            at = first[:n] + t
            if t == 0:
                best[at] = emit[at] + self.start
            else:
                options = best[at - 1][:, :, None] + self.trans
                back[at] = options.argmax(1)
                best[at] = emit[at] + options.max(1)
        out = np.zeros(len(emit), np.int64)
        for t in range(len(running) - 1, -1, -1):
            n = int(running[t])
            done = 0 if t == len(running) - 1 else int(running[t + 1])
            ends = first[done:n] + t
            out[ends] = best[ends].argmax(1)
            at = first[:done] + t
            out[at] = back[at + 1, out[at + 1]]
        return out
