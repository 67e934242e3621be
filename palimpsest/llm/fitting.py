"""Fits the hidden Markov model of problem 9 to labelled documents; quality.py states the result as fixed values."""

from __future__ import annotations

import numpy as np

from . import quality as Q

#: Most labelled documents that a fit reads.
MOST_LABELLED = 6_000
#: Added to each count, and the least log-likelihood of a bin (of the bin of repeated units: none).
SMOOTHING, FLOOR = 0.5, -6.0


def fit(texts: list[str], labels: list[str], v: Q.Vocabulary, whole: list[bool] | None = None, rounds: int = 6) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(log-likelihoods per statistic, moves, first) from documents with one state each, by Viterbi training.

    A document labelled other than prose may begin with prose, so each of its units is prose or of that state, unless
    `whole` says that all of it is; prose documents may hold units of any state. Units take their most likely state under the present model, then counts of
    bins and moves give the next model. The first model counts all units of a document under its state.
    """
    if len(texts) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled documents")
    u, _ = Q.measure(texts, v)
    bins = {name: np.searchsorted(bounds, u.stats[name], "right") for name, (bounds, _) in Q.EMISSIONS.items()}
    tables = {name: np.zeros((len(bounds) + 1, len(Q.STATES))) for name, (bounds, _) in Q.EMISSIONS.items()}
    moves = first = None
    k_states = len(Q.STATES)
    given = np.array([Q.STATES.index(x) for x in labels])[u.text]
    open_ = np.zeros((len(u.text), k_states), bool)
    open_[:, 0] = ~np.array(whole if whole is not None else [False] * len(texts))[u.text]
    open_[np.arange(len(given)), given] = True
    open_[given == 0] = True
    begins = np.flatnonzero(np.diff(u.text, prepend=-1))
    inside = np.setdiff1d(np.arange(1, len(u.text)), begins)
    for k in range(rounds):
        e = sum(tables[name][bins[name]] for name in tables) * Q.weight(u.chars)[:, None]
        z = Q.viterbi(np.where(open_, e, -1e6), u.text, len(texts), moves, first) if k else given
        for name, t in tables.items():
            counts = np.full(t.shape, SMOOTHING)
            np.add.at(counts, (bins[name], z), 1)
            tables[name] = np.maximum(np.log(counts / counts.sum(axis=0)), FLOOR if name != "repeated" else -np.inf)
        pair = np.full((k_states, k_states), SMOOTHING)
        np.add.at(pair, (z[inside - 1], z[inside]), 1)
        moves = np.maximum(np.log(pair / pair.sum(axis=1, keepdims=True)), FLOOR)
        start = np.bincount(z[begins], minlength=k_states) + SMOOTHING
        first = np.log(start / start.sum())
    return tables, moves, first
