"""Decoding and forced alignment of frames of symbol scores, where the last symbol is the blank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

NONE = float("-inf")


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def deviation(logp: np.ndarray) -> float:
    """How far the frames' probabilities are from summing to 1, at most, in logarithms."""
    return float(np.abs(np.logaddexp.reduce(logp, axis=-1)).max()) if len(logp) else 0.0


def check_alphabet(letters: Sequence[str], blank: str) -> None:
    """The letters must be distinct, with the blank once and last."""
    if len(set(letters)) != len(letters):
        raise ValueError("a letter comes twice")
    if not letters or letters[-1] != blank:
        raise ValueError("the last letter must be the blank")


class NgramModel:
    """A letter n-gram model with add-k smoothing and back-off to shorter contexts; its state is the last n-1 letters."""

    def __init__(self, counts: dict[str, dict[str, float]], order: int, letters: Sequence[str], k: float = 0.1) -> None:
        self.counts, self.order, self.letters, self.k = counts, order, list(letters), k

    @classmethod
    def trained(cls, texts: Sequence[str], order: int, letters: Sequence[str]) -> NgramModel:
        counts: dict[str, dict[str, float]] = {}
        for t in texts:
            t += "\n"
            for i, c in enumerate(t):
                for n in range(order):
                    if i >= n:
                        by = counts.setdefault(t[i - n : i], {})
                        by[c] = by.get(c, 0) + 1
        return cls(counts, order, letters)

    def start(self, before: str = "") -> str:
        return before[-(self.order - 1) :] if self.order > 1 else ""

    def advance(self, state: str, letter: str) -> str:
        return (state + letter)[-(self.order - 1) :] if self.order > 1 else ""

    def score(self, state: str, letter: str) -> float:
        for at in range(len(state) + 1):
            if by := self.counts.get(state[at:]):
                return float(np.log((by.get(letter, 0) + self.k) / (sum(by.values()) + self.k * (len(self.letters) + 1))))
        return float(-np.log(len(self.letters) + 1))

    def end(self, state: str) -> float:
        return self.score(state, "\n")


def prefix_beam(
    logp: np.ndarray, letters: Sequence[str], k: int = 8, lm: NgramModel | None = None, lm_scale: float = 1.0, bonus: float = 0.0, before: str = "",
    end: bool = False, floor: float = -10.0, most_deviation: float | None = 1e-3, select: Callable[[np.ndarray], np.ndarray] | None = None,
) -> tuple[list[tuple[str, float, float]], str]:
    """(hypotheses, state): the k best texts of a line as (text, visual score, model score), the best visual score first, and the model's state after the best of all.

    A prefix is scored by the probability of all paths to it that end in a blank and of those that don't. Symbols of at most `floor` are left
    out of a frame. With a model, prefixes are kept by visual score + lm_scale * (model score + bonus for each letter)."""
    if not isinstance(k, int) or isinstance(k, bool):
        raise TypeError("the beam's size must be an integer")
    if k < 1:
        raise ValueError("the beam's size must be 1 at least")
    if most_deviation is not None and deviation(logp) > most_deviation:
        raise ValueError("the frames aren't normalised")
    blank = len(letters) - 1
    beam = {"": (0.0, NONE, 0.0, lm.start(before) if lm else "")}  # ends in blank, doesn't, model score, model state
    add = np.logaddexp
    for p in logp:
        chosen = select(p) if select else np.flatnonzero(p > floor)
        kept = [int(c) for c in chosen if c != blank]
        grown: dict[str, list] = {}
        for text, (b, nb, m, state) in beam.items():
            stay = float(p[blank]) + add(b, nb)
            again = nb + float(p[letters.index(text[-1])]) if text and letters.index(text[-1]) in kept else NONE
            grown[text] = [stay, again, m, state]
        if kept:
            for text, (b, nb, m, state) in beam.items():
                for c in kept:
                    letter = letters[c]
                    new = b + float(p[c]) if text and text[-1] == letter else add(b, nb) + float(p[c])
                    if text + letter in beam:
                        grown[text + letter][1] = add(grown[text + letter][1], new)
                    elif new > NONE:
                        extra = lm.score(state, letter) + bonus if lm else 0.0
                        grown[text + letter] = [NONE, new, m + extra, lm.advance(state, letter) if lm else ""]
        total = {t: add(v[0], v[1]) + lm_scale * v[2] for t, v in grown.items()}
        best = sorted((t for t in grown if total[t] > NONE), key=lambda t: (-total[t], t))[:k]
        beam = {t: tuple(grown[t]) for t in best}
    out = []
    for text, (b, nb, m, state) in beam.items():
        out.append((text, float(add(b, nb)), m + (lm.end(state) if lm and end else 0.0), state))
    out.sort(key=lambda h: (-h[1], h[0]))
    state = max(out, key=lambda h: h[1] + lm_scale * h[2])[3] if out else ""
    return [h[:3] for h in out], state


def greedy(logp: np.ndarray, letters: Sequence[str]) -> tuple[str, float]:
    """(text, score): the best symbol of each frame, runs collapsed, blanks dropped; the score is the logarithm of the sum of the frames' best probabilities."""
    if not len(logp):
        return "", NONE
    best = logp.argmax(axis=1)
    run = np.r_[True, best[1:] != best[:-1]]
    return "".join(letters[i] for i in best[run] if i != len(letters) - 1), float(np.logaddexp.reduce(logp.max(axis=1)))


def forced_alignment(cost: np.ndarray, symbols: Sequence[int], blank: int, positions: bool = False) -> list[int]:
    """The symbol (or its position in the text, -1 for blank) of each frame on the cheapest path that spells `symbols`.

    States are blank, s1, blank, ..., sn, blank; a path stays, moves on by one, or skips the blank between different symbols, and ends in one of the last two states.
    Ties go to the lowest state before. Raises ValueError for an empty text, a blank in the text and too few frames."""
    symbols = list(symbols)
    if not symbols:
        raise ValueError("nothing to align")
    if blank in symbols:
        raise ValueError("the text holds the blank")
    n = 2 * len(symbols) + 1
    state = np.full(n, blank)
    state[1::2] = symbols
    skip = np.zeros(n, bool)
    skip[3::2] = state[3::2] != state[1:-2:2]
    total = np.full(n, np.inf)
    if len(cost):
        total[:2] = cost[0, state[:2]]
    back = np.zeros((len(cost), n), np.int64)
    at = np.arange(n)
    for t in range(1, len(cost)):
        two = np.where(skip, np.r_[np.inf, np.inf, total[:-2]], np.inf)
        options = np.stack([two, np.r_[np.inf, total[:-1]], total])
        which = options.argmin(axis=0)
        back[t] = at - 2 + which
        total = options[which, at] + cost[t, state]
    last = n - 2 + int(total[n - 1] < total[n - 2])
    if not len(cost) or not np.isfinite(total[last]):
        raise ValueError("the text can't be aligned to so few frames")
    out = [last]
    for t in range(len(cost) - 1, 0, -1):
        out.append(int(back[t, out[-1]]))
    out.reverse()
    return [(s - 1) // 2 if s % 2 else -1 for s in out] if positions else [int(state[s]) for s in out]


def letter_frames(cost: np.ndarray, symbols: Sequence[int], blank: int) -> list[int]:
    """For each letter, the frame among those aligned to it with the highest probability of any symbol; the earliest at a tie."""
    where = np.array(forced_alignment(cost, symbols, blank, positions=True))
    best = -cost.min(axis=1)
    return [int(f[np.argmax(best[f])]) for f in (np.flatnonzero(where == i) for i in range(len(symbols)))]


def letter_confidences(prob: np.ndarray, symbols: Sequence[int], frames: Sequence[int]) -> list[float]:
    """How much more probable each letter is at its frame than any competitor around it: any symbol but its own, its neighbours' and the blank, in the frames up to halfway to the next letters; 0 at least."""
    n, width = len(symbols), prob.shape[1]
    borders = [0, *((a + 1 + b) // 2 for a, b in zip(frames, frames[1:])), len(prob)]
    out = []
    for i, (s, f) in enumerate(zip(symbols, frames)):
        free = np.ones(width, bool)
        free[[*symbols[max(0, i - 1) : i + 2], width - 1]] = False
        window = prob[borders[i] : max(borders[i + 1], borders[i] + 1)][:, free]
        rival = float(window.max()) if window.size else 0.0
        out.append(max(0.0, float(prob[f, s]) - rival))
    return out if n else []
