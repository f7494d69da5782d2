"""What the two weakly supervised operators share: expectation-maximisation
over vote patterns, and a linear model on hashed features."""

from __future__ import annotations

import numpy as np

#: Outcomes of a labeller, in the order of the tables: against, abstains, for.
AGAINST, ABSTAINS, FOR = 0, 1, 2


def patterns_to_array(patterns: list[str]) -> np.ndarray:
    """Patterns are strings of -, 0 and +, a character for each labeller."""
    code = {"-": AGAINST, "0": ABSTAINS, "+": FOR}
    return np.array([[code[c] for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)


def reliabilities(patterns: list[str], counts: list[int], start: tuple[float, float] = (0.75, 0.75), strength: tuple[float, float] = (2.0, 2.0), prior: float = 0.5, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for two classes and labellers that are independent
    within a class; an abstention says nothing. Gives each pattern's posterior of
    the positive class, the table P(right vote | class, it votes) as labeller x
    class, and the class prior.

    `start` holds how often a labeller is at first taken to be right on the
    negative and on the positive class; `strength` pseudo-counts for each hold it
    to that.
    """
    if not patterns:
        return np.empty(0), np.empty((0, 2)), prior
    votes, n = patterns_to_array(patterns), np.array(counts, float)
    table = np.tile(np.array(start), (votes.shape[1], 1))
    cast, right, post = votes != ABSTAINS, np.stack([votes == AGAINST, votes == FOR]), None
    for _ in range(rounds):
        yes, no = np.log(table), np.log(1 - table)
        score = [np.where(cast, np.where(right[c], yes[:, c], no[:, c]), 0).sum(axis=1) for c in (0, 1)]
        odds = score[1] - score[0] + np.log(prior / (1 - prior))
        was, post = post, 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if was is not None and np.abs(post - was).max() < 1e-9:
            break
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            table[:, c] = ((right[c] * w[:, None]).sum(axis=0) + strength[c] * start[c]) / ((cast * w[:, None]).sum(axis=0) + strength[c])
        table = np.clip(table, 1e-4, 1 - 1e-4)
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3))
    return post, table, prior


def latent_classes(patterns: list[str], counts: list[int], sharp: float = 0.9, blunt: float = 0.02, good: float = 0.002, strength: float = 2.0, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation where the negative class falls into kinds, each of
    which another labeller knows best: class 0 is the positive one, class k the kind
    of labeller k - 1. Gives each pattern's posterior of every class, the table
    P(against | class, it votes) as class x labeller, and the shares of the classes.

    `sharp`, `blunt` and `good` are only where the search begins (a labeller on its
    own kind, on other kinds, on the positive class); all rates and shares then move
    freely, held by no more than `strength` pseudo-votes each.
    """
    if not patterns:
        return np.empty((0, 1)), np.empty((1, 0)), np.ones(1)
    votes, n = patterns_to_array(patterns), np.array(counts, float)
    labellers = votes.shape[1]
    begin = np.vstack([np.full(labellers, good), np.where(np.eye(labellers) > 0, sharp, blunt)])
    table, share = begin.copy(), np.concatenate([[0.5], np.full(labellers, 0.5 / labellers)])
    against, cast, post = (votes == AGAINST).astype(float), (votes != ABSTAINS).astype(float), None
    for _ in range(rounds):
        score = against @ np.log(table).T + (cast - against) @ np.log(1 - table).T + np.log(share)
        e = np.exp(score - score.max(axis=1, keepdims=True))
        was, post = post, e / e.sum(axis=1, keepdims=True)
        if was is not None and np.abs(post - was).max() < 1e-9:
            break
        w = post * n[:, None]
        table = np.clip((w.T @ against + strength * begin) / (w.T @ cast + strength), 1e-6, 1 - 1e-6)
        share = (w.sum(axis=0) + 1e-3) / (n.sum() + 1e-3 * len(share))
    return post, table, share


def fit_linear(rows: list[list[int]], values: list[list[float]], target: list[float], weight: list[float], dims: int, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by full-batch Adagrad on sparse rows; the bias is last."""
    w = np.zeros(dims + 1)
    if not rows:
        return w
    length = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), length)
    col = np.fromiter((c for r in rows for c in r), np.int64, length.sum())
    val = np.fromiter((v for r in values for v in r), float, length.sum())
    y, share = np.array(target), np.array(weight) / np.sum(weight)
    past = np.full(dims + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[col] * val, minlength=len(rows)) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        g = np.append(np.bincount(col, weights=off[row] * val, minlength=dims), off.sum()) + l2 * np.append(w[:-1], 0)
        past += g * g
        w -= rate * g / np.sqrt(past)
    return w
