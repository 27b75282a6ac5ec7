"""Confusion networks: a list of positions, each a dict of symbol (or None) to weight."""

from __future__ import annotations

import math
from collections.abc import Iterable

from quirekit.functions.sequence import BOTH, TARGET, path

Network = list[dict]


def pivot(network: Network) -> list:
    """The heaviest symbol of each position, the first at a tie."""
    return [max(p, key=p.get) for p in network]


def added(network: Network, text: str, weight: float) -> Network:
    """The network with a hypothesis aligned to its pivot: matches and substitutions add to a position, a skipped position adds to None, new symbols open a position in their order."""
    if not network:
        return [{c: weight} for c in text]
    spine = pivot(network)
    mean = sum(sum(p.values()) for p in network) / len(network)
    out, i, j = [], 0, 0
    for step in path(list(text), [("", s) if s is None else s for s in spine]):
        if step == TARGET:
            p = dict(network[j])
            p[None] = p.get(None, 0.0) + weight
        elif step == BOTH:
            p = dict(network[j])
            p[text[i]] = p.get(text[i], 0.0) + weight
        else:
            p = {None: mean, text[i]: weight}
        out.append(p)
        i += step != TARGET
        j += step in (TARGET, BOTH)
    return out


def normalised(network: Network) -> Network:
    return [{s: w / total for s, w in p.items()} for p in network for total in [sum(p.values())]]


def produced(bag: Iterable[tuple[str, float, float | None]], visual_weight: float = 1.0, lm_weight: float = 1.0, normalise: bool = True) -> Network:
    """The network of a bag of (text, visual score, model score), each weighing the exponential of its weighted scores; a missing model score counts as 0."""
    network: Network = []
    for text, visual, model in bag:
        network = added(network, text, math.exp(visual_weight * visual + lm_weight * (model or 0.0)))
    return normalised(network) if normalise else network


def best_text(network: Network) -> str:
    return "".join(s for s in pivot(network) if s is not None)


def paths(network: Network) -> list[tuple[str, float]]:
    """All paths through the network with their products of weights, the most probable first; equal texts stay apart."""
    out = [("", 1.0)]
    for p in network:
        out = [(t + (s or ""), w * v) for t, w in out for s, v in p.items()]
    return sorted(out, key=lambda x: -x[1])
