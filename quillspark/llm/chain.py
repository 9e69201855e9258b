"""Viterbi decoding of many sequences at once."""

from __future__ import annotations

import numpy as np


def viterbi(score: np.ndarray, begin: np.ndarray, length: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best state of each step of sequences that lie one after another in ``score`` (steps, states).

    ``t[a, b]`` adds for b after a, ``first`` and ``last`` for the ends of a sequence. All
    sequences step together, longest first, so those that have ended drop off the end.
    """
    out = np.zeros(len(score), np.int8)
    if not len(begin):
        return out
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    state = first + score[begin]
    back: list[np.ndarray] = []
    for step in range(1, int(length[0])):
        alive = int(np.searchsorted(-length, -step, "left"))
        ways = state[:alive, :, None] + t
        back.append(ways.argmax(1).astype(np.int8))
        state[:alive] = ways.max(1) + score[begin[:alive] + step]
    label = (state + last).argmax(1).astype(np.int8)
    for step in range(int(length[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-length, -step, "left"))
        out[begin[:alive] + step] = label[:alive]
        if step:
            label[:alive] = back[step - 1][np.arange(alive), label[:alive]]
    return out
