"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are sequences of word vectors, each the embedding of the word next to the scaled sum of the embeddings of
its character n-grams. The score of a sequence is a linear function of the attention-weighted mean of states.
"""

from __future__ import annotations

import numpy as np

WORD_DIM = CHAR_DIM = 8
HIDDEN = 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(words: np.ndarray, grams: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Weights; the first embedding dimension starts as the given evidence of each word and n-gram.

    The last row of both embeddings is the zero vector of anything else, and stays so.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)
    out = {"words": normal(len(words) + 1, WORD_DIM), "grams": normal(len(grams) + 1, CHAR_DIM),
           "attend": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    out["words"][:-1, 0], out["grams"][:-1, 0] = words, grams
    out["words"][-1], out["grams"][-1] = 0, 0
    for side in "fb":
        out[f"in_{side}"] = normal(WORD_DIM + CHAR_DIM, 3 * HIDDEN) * 3
        out[f"state_{side}"] = normal(HIDDEN, 3 * HIDDEN) * 3
        out[f"bias_{side}"] = np.zeros(3 * HIDDEN, np.float32)
    return out


def word_vectors(weights: dict, word: np.ndarray, gram: np.ndarray, owner: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Vectors of distinct words from their row in ``words``, and rows in ``grams`` with the word they belong to."""
    chars = np.stack([np.bincount(owner, weights=weights["grams"][gram, d], minlength=len(word)) for d in range(CHAR_DIM)],
                     axis=1) * scale[:, None]
    return np.concatenate([weights["words"][word], chars], axis=1).astype(np.float32)


def _run(weights: dict, side: str, projected: np.ndarray, rows: np.ndarray, here: np.ndarray, keep: list | None) -> np.ndarray:
    """States after every step, (steps, sequences, HIDDEN); ``rows`` are positions in ``projected`` by step."""
    h = np.zeros((rows.shape[1], HIDDEN), np.float32)
    states = np.empty((len(rows), rows.shape[1], HIDDEN), np.float32)
    for t in range(len(rows)):
        x = projected[rows[t]]
        s = h @ weights[f"state_{side}"]
        gates = _sigmoid(x[:, :2 * HIDDEN] + s[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * s[:, 2 * HIDDEN:])
        new = c + z * (h - c)
        if keep is not None:
            keep.append((h, z, r, c, s[:, 2 * HIDDEN:]))
        h = np.where(here[t][:, None], new, h)
        states[t] = h
    return states


def projected(weights: dict, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What word vectors add to the gates, ahead and behind."""
    return vectors @ weights["in_f"] + weights["bias_f"], vectors @ weights["in_b"] + weights["bias_b"]


def forward(weights: dict, inputs: tuple, rows: np.ndarray, here: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logit of each sequence; ``rows`` (steps, sequences) are positions in ``inputs``, ``here`` says which are words."""
    keeps = ([], []) if trace is not None else (None, None)
    ahead = _run(weights, "f", inputs[0], rows, here, keeps[0])
    behind = _run(weights, "b", inputs[1], rows[::-1], here[::-1], keeps[1])[::-1]
    states = np.concatenate([ahead, behind], axis=2)
    level = np.where(here, states @ weights["attend"], -1e9)
    share = np.exp(level - level.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (share[:, :, None] * states).sum(axis=0)
    if trace is not None:
        trace.update(keeps=keeps, states=states, share=share, pooled=pooled)
    return pooled @ weights["out"] + weights["bias"][0]


def _run_back(weights: dict, side: str, grad: dict, rows: np.ndarray, here: np.ndarray, keep: list, from_states: np.ndarray,
              vectors: np.ndarray) -> np.ndarray:
    """Gradient of the word vectors; adds the gradients of this direction's weights to ``grad``."""
    on_input = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
    carry = np.zeros_like(from_states[0])
    for t in range(len(rows) - 1, -1, -1):
        h, z, r, c, s = keep[t]
        carry = carry + from_states[t]
        live = here[t][:, None]
        g = np.where(live, carry, 0)
        gz, gc = g * (h - c) * z * (1 - z), g * (1 - z) * (1 - c * c)
        gr = gc * s * r * (1 - r)
        on_state = np.concatenate([gz, gr, gc * r], axis=1)
        np.add.at(on_input, rows[t], np.concatenate([gz, gr, gc], axis=1))
        grad[f"state_{side}"] += h.T @ on_state
        carry = np.where(live, g * z, carry) + on_state @ weights[f"state_{side}"].T
    grad[f"in_{side}"] += vectors.T @ on_input
    grad[f"bias_{side}"] += on_input.sum(axis=0)
    return on_input @ weights[f"in_{side}"].T


def gradient(weights: dict, word: np.ndarray, gram: np.ndarray, owner: np.ndarray, scale: np.ndarray, rows: np.ndarray,
             here: np.ndarray, target: np.ndarray, cost: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted cross-entropy of sequences and its gradient."""
    vectors, trace = word_vectors(weights, word, gram, owner, scale), {}
    logit = forward(weights, projected(weights, vectors), rows, here, trace)
    total = cost.sum()
    loss = float((cost * (np.logaddexp(0, logit) - target * logit)).sum() / total)
    on_logit = (cost * (_sigmoid(logit) - target) / total).astype(np.float32)
    grad = {name: np.zeros_like(value) for name, value in weights.items()}
    states, share = trace["states"], trace["share"]
    grad["out"] += trace["pooled"].T @ on_logit
    grad["bias"] += on_logit.sum()
    on_pooled = on_logit[:, None] * weights["out"]
    on_share = (states * on_pooled).sum(axis=2)
    on_level = share * (on_share - (share * on_share).sum(axis=0))
    grad["attend"] += (states * on_level[:, :, None]).sum(axis=(0, 1))
    on_states = share[:, :, None] * on_pooled + on_level[:, :, None] * weights["attend"]
    on_vectors = _run_back(weights, "f", grad, rows, here, trace["keeps"][0], on_states[:, :, :HIDDEN], vectors)
    on_vectors = on_vectors + _run_back(weights, "b", grad, rows[::-1], here[::-1], trace["keeps"][1],
                                        on_states[::-1, :, HIDDEN:], vectors)
    np.add.at(grad["words"], word, on_vectors[:, :WORD_DIM])
    np.add.at(grad["grams"], gram, (on_vectors[:, WORD_DIM:] * scale[:, None])[owner])
    grad["words"][-1], grad["grams"][-1] = 0, 0
    return loss, grad


class Adam:
    def __init__(self, weights: dict, rate: float):
        self.rate, self.n = rate, 0
        self.moment = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, weights: dict, grad: dict) -> None:
        self.n += 1
        for k, g in grad.items():
            self.moment[k] = 0.9 * self.moment[k] + 0.1 * g
            self.square[k] = 0.99 * self.square[k] + 0.01 * g * g
            weights[k] -= self.rate * (self.moment[k] / (1 - 0.9 ** self.n)) / (
                np.sqrt(self.square[k] / (1 - 0.99 ** self.n)) + 1e-7)
