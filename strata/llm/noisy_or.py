"""Multiple-instance logistic model in numpy: sentence probabilities combined by noisy-or, fitted from document labels.

A document is toxic if one of its sentences is: with z the log-odds of a sentence, P(document) = 1 - prod(1 - sigmoid(z))
= 1 - exp(-sum(softplus(z))). Sentences hold a sparse set of binary features (hashed words).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class NoisyOr:
    """A weight for each feature bucket, and the log-odds of a sentence without features."""

    weights: np.ndarray
    bias: float

    def log_odds(self, features: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n sentences; features[i] is one of sentence owners[i]."""
        return self.bias + np.bincount(owners, self.weights[features], minlength=n)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def either(z: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """Noisy-or of each bag [bags[i], bags[i + 1]) of sentences; a bag without one has probability 0."""
    total = np.concatenate([[0.0], np.cumsum(softplus(z))])
    return -np.expm1(-(total[bags[1:]] - total[bags[:-1]]))


def fit_noisy_or(features: np.ndarray, owners: np.ndarray, bags: np.ndarray, y: np.ndarray, buckets: int, least_docs: int = 3, sparse: float = 0.04, rounds: int = 300, first: int = 60, rate: float = 0.2) -> NoisyOr:
    """Proximal gradient (Adagrad steps, soft threshold) on the documents' cross-entropy.

    Only features of ``least_docs`` documents or more get a weight. The threshold grows with the root of the number of positive
    documents, so that words which meet by chance in some of them stay at zero; what is at zero after the ``first`` rounds stays
    there. Without both labels all weights are zero.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    n, sizes = int(bags[-1]), np.diff(bags)
    mean = max(n / max(len(y), 1), 1.0)
    model = NoisyOr(np.zeros(buckets), float(np.log(-np.log1p(-share) / mean)))
    if not (0 < y.sum() < len(y)):
        return model
    doc_of = np.repeat(np.arange(len(y)), sizes)
    in_docs = np.bincount(np.unique(doc_of[owners].astype(np.int64) * buckets + features) % buckets, minlength=buckets)
    held = np.flatnonzero(in_docs >= least_docs)
    place = np.full(buckets, -1)
    place[held] = np.arange(len(held))
    some = place[features] >= 0
    x, owner = place[features[some]], owners[some]
    w, b = np.zeros(len(held)), model.bias
    seen, seen_b = np.full(len(held), 1e-3), 1e-3
    limit = sparse * np.sqrt(y.sum())
    for k in range(rounds):
        if k == first:
            some = w[x] != 0
            x, owner = x[some], owner[some]
        z = b + np.bincount(owner, w[x], minlength=n)
        p = np.clip(either(z, bags), 1e-6, 1 - 1e-6)
        dz = sigmoid(z) * np.where(y > 0.5, -(1 - p) / p, 1.0)[doc_of]
        slope = np.bincount(x, dz[owner], minlength=len(held))
        seen += slope**2
        step = rate / np.sqrt(seen)
        w = w - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * limit, 0)
        seen_b += dz.sum() ** 2
        b -= rate * dz.sum() / np.sqrt(seen_b)
    model.weights[held], model.bias = w, float(b)
    return model
