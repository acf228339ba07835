"""Sampling how many tables the customers of one dish sit at, in a Pitman-Yor restaurant; NumPy inside tasks.

Given the others' tables, t tables for c customers of a dish of parent probability p have
the weight S(c, t) p^t (strength + discount others) ... (strength + discount (others + t - 1)), S the generalised
Stirling numbers. That is the law of the tables once every customer of the cell has left and come back.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Tables of a cell up to this many are drawn from their exact weights.
TABLES = 128
#: Customers up to which Stirling numbers come from their recurrence; beyond, from its limit.
EXACT = 2048
#: Groups that a restaurant's cells are dealt to: each group moves given the tables that the others have by then.
GROUPS = 8


@lru_cache(maxsize=4)
def _ratios(discount: float) -> np.ndarray:
    """Row c: S(c, t) / S(c, 1) for t = 1, 2, ..., by S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    t = np.arange(1, TABLES + 1)
    rows = np.zeros((EXACT + 1, TABLES))
    rows[1, 0] = 1
    for c in range(1, EXACT):
        rows[c + 1] = rows[c] * np.maximum(c - discount * t, 0) / (c - discount)
        rows[c + 1, 1:] += rows[c, :-1] / (c - discount)
    return rows


def _row(c: int, discount: float) -> np.ndarray:
    """The same for any c: beyond EXACT the recurrence is a differential equation in log c with a closed solution."""
    if c <= EXACT:
        return _ratios(discount)[c]
    x = (c / EXACT) ** -discount
    steps = np.arange(TABLES)
    fresh = np.exp(steps * math.log((1 - x) / discount) - np.array([math.lgamma(k + 1) for k in steps])) if x < 1 else (steps == 0).astype(float)
    return np.convolve(_ratios(discount)[EXACT] * x**steps, fresh)[:TABLES]


def _stirling(c: np.ndarray, discount: float, width: int) -> np.ndarray:
    if c.max() <= EXACT:
        rows = _ratios(discount)[c, :width]
    else:
        kinds, at = np.unique(c, return_inverse=True)
        rows = np.stack([_row(int(k), discount)[:width] for k in kinds])[at]
    with np.errstate(divide="ignore"):
        return np.log(rows)


def _many(c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables where they may be more than TABLES: the weights' limit for many customers, a negative binomial; seated in blocks where nearly each customer opens a table."""
    q = np.minimum(p, 0.999)
    r = strength / discount + others + 1
    out = np.minimum(1 + rng.negative_binomial(r, 1 - q), c)
    for k in np.flatnonzero(r * q / (1 - q) > c / 4):
        t, seated = 1, 1
        while seated < c[k]:
            block = int(min(max(seated // 16, 1), c[k] - seated))
            new = (strength + discount * (others[k] + t)) * p[k]
            t += int(rng.binomial(block, new / (new + seated - discount * t)))
            seated += block
        out[k] = t
    return out


def draw(c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """One draw of the tables of cells with c customers, given the others' tables and the parent's probabilities."""
    out = np.ones(len(c), np.int64)
    for low, high, width in ((2, 8, 8), (9, 64, 64), (65, None, TABLES)):
        at = np.flatnonzero((c >= low) & (c <= (high or np.inf)))
        for part in np.array_split(at, max(1, -(-len(at) * width // 2_000_000))):
            if not len(part):
                continue
            t = np.arange(width)
            opened = np.log(strength + discount * (others[part][:, None] + t)) + np.log(p[part])[:, None]
            log_weight = _stirling(c[part], discount, width) + np.cumsum(opened, axis=1)
            weight = np.exp(log_weight - log_weight.max(axis=1, keepdims=True))
            upto = np.cumsum(weight, axis=1)
            out[part] = 1 + (upto < rng.random(len(part))[:, None] * upto[:, -1:]).sum(axis=1)
            if high is None:
                wide = part[(weight[:, -1] > 1e-9 * upto[:, -1]) & (c[part] > TABLES)]
                if len(wide):
                    out[wide] = _many(c[wide], others[wide], p[wide], strength, discount, rng)
    return out


def sweep(first: np.ndarray, c: np.ndarray, t: np.ndarray, fixed: np.ndarray, p: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """New tables of all cells of several restaurants: cell k to l of restaurant i are first[i] to first[i + 1].

    fixed: tables of a restaurant that do not move. The cells of a restaurant are dealt
    to GROUPS at random, which move in turn: small restaurants move one cell at a time.
    """
    sizes = np.diff(first)
    of = np.repeat(np.arange(len(sizes)), sizes)
    shuffled = np.lexsort((rng.random(len(c)), of))
    group = np.empty(len(c), np.int64)
    group[shuffled] = (np.arange(len(c)) - np.repeat(first[:-1], sizes)) % GROUPS
    t = t.copy()
    total = fixed + np.bincount(of, weights=t, minlength=len(sizes))
    for g in range(GROUPS):
        k = np.flatnonzero(group == g)
        if len(k):
            new = draw(c[k], total[of[k]] - t[k], p[k], strength, discount, rng)
            total += np.bincount(of[k], weights=new - t[k], minlength=len(sizes))
            t[k] = new
    return t
