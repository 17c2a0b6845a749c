"""Sequential decoders: array recurrences that run once for each group of rows (a sample's contig, a window)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Emissions and costs of decoders are multiples of 1 / GRID, so sums of them below 2 ** 53 / GRID are exact.
GRID = float(1 << 28)


def grid(x):
    """The nearest multiples of the grid's step; scores of paths then tie where they are equal, in whatever order they are summed."""
    return np.round(np.asarray(x, dtype=np.float64) * GRID) / GRID


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def viterbi(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best path of a general model in log space; of equal predecessors the lowest."""
    n, s = emit.shape
    back = np.zeros((n, s), dtype=np.int32)
    score = start + emit[0]
    for t in range(1, n):
        step = score[:, None] + trans
        back[t] = step.argmax(axis=0)
        score = step[back[t], np.arange(s)] + emit[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def viterbi_switch(emit: np.ndarray, stay: float, switch: float) -> np.ndarray:
    """The same where any change costs alike: one pass over the states a step instead of a square."""
    n, s = emit.shape
    moved = np.zeros((n, s), dtype=bool)
    best = np.zeros(n, dtype=np.int64)
    score = emit[0] - grid(np.log(s))
    for t in range(1, n):
        best[t] = score.argmax()
        jump = score[best[t]] + switch
        keep = score + stay
        moved[t] = jump > keep
        score = np.maximum(keep, jump) + emit[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = best[t] if moved[t, path[t]] else path[t]
    return path


def pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unordered pairs i <= j of k founders."""
    return np.triu_indices(k)


def pair_emissions(log_em: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Emissions of pairs as sums of their founders' logs, less a penalty where both are the same founder."""
    i, j = pairs(log_em.shape[-1])
    return log_em[..., i] + log_em[..., j] - penalty * (i == j)


def pair_transitions(log_a: np.ndarray) -> np.ndarray:
    """Transitions of pairs as sums of their slots' logs."""
    i, j = pairs(log_a.shape[0])
    return log_a[np.ix_(i, i)] + log_a[np.ix_(j, j)]


def hmm_haploid(cells: np.ndarray, weights: np.ndarray, p_stay: float = 0.99) -> np.ndarray:
    """Founder path from read support: softmax emissions of weighted cells."""
    k = cells.shape[1]
    rest = np.log((1 - p_stay) / max(k - 1, 1)) if k > 1 else -np.inf
    return viterbi_switch(grid(log_softmax(cells * weights)), grid(np.log(p_stay)), grid(rest))


def ordered_transitions(k: int, p_stay: float = 0.99, two: float = -1e6) -> np.ndarray:
    """Transitions of pairs by slots: one switch if either slot stays as it is, else a prohibitive cost."""
    i, j = pairs(k)
    same = (i[:, None] == i) & (j[:, None] == j)
    one = (i[:, None] == i) | (j[:, None] == j)
    rest = np.log((1 - p_stay) / max(k - 1, 1)) if k > 1 else 0.0
    return np.where(same, np.log(p_stay), np.where(one, rest, two))


def hmm_diploid(cells: np.ndarray, weights: np.ndarray, p_stay: float = 0.99, homozygous: float = -0.1, two: float = -1e6) -> np.ndarray:
    """Pairs of founders of each site (two columns): both founders' emissions, a penalty for equal ones.

    Transitions are those of ``ordered_transitions``; as they depend on slots alone, a step needs the
    best score of each slot's founder and of all, not a square of pairs. Ties go to the lowest pair.
    """
    n, k = cells.shape
    log_em = grid(log_softmax(cells * weights))
    upper = np.triu(np.ones((k, k), dtype=bool))
    base = np.where(upper, np.eye(k) * grid(homozygous), -np.inf)
    stay, two = grid(np.log(p_stay)), grid(two)
    rest = grid(np.log((1 - p_stay) / max(k - 1, 1)) if k > 1 else 0.0)
    own = np.arange(k * k).reshape(k, k)
    came = np.empty((n, k, k), dtype=np.int32)
    score = base + log_em[0][:, None] + log_em[0][None, :] - grid(np.log(k * (k + 1) / 2))
    side = np.arange(k)
    for t in range(1, n):
        by_first, by_second = score.argmax(axis=1), score.argmax(axis=0)
        first, second = score[side, by_first] + rest, score[by_second, side] + rest
        top = int(score.argmax())
        values = np.stack([score + stay, np.broadcast_to(first[:, None], (k, k)), np.broadcast_to(second[None, :], (k, k)), np.full((k, k), score.flat[top] + two)])
        sources = np.stack([own, np.broadcast_to((side * k + by_first)[:, None], (k, k)), np.broadcast_to((by_second * k + side)[None, :], (k, k)), np.full((k, k), top)])
        best = values.max(axis=0)
        came[t] = np.where(values == best, sources, k * k).min(axis=0)
        score = best + base + log_em[t][:, None] + log_em[t][None, :]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t].flat[path[t]]
    return np.stack(np.divmod(path, k), axis=1)


def stay_of_weights(weights: np.ndarray) -> float:
    """Probability to stay, from the largest weight of a founder."""
    p = 0.2 * float(np.max(weights))
    if not 0 < p < 1:
        raise ValueError("the largest weight must lie between 0 and 5")
    return p


def logits_haploid(logits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Founder path of a model's logits; staying may be less likely than a change."""
    k = logits.shape[1]
    p = stay_of_weights(weights)
    trans = np.full((k, k), np.log((1 - p) / max(k - 1, 1)))
    np.fill_diagonal(trans, np.log(p))
    return viterbi(log_softmax(logits), trans, np.full(k, -np.log(k)))


def logits_transitions(weights: np.ndarray, homozygous: float = -0.1, two: float = -1e6) -> tuple[np.ndarray, float]:
    """(transitions of pairs, what equal founders add) of ``logits_diploid``."""
    k = len(weights)
    i, j = pairs(k)
    p = stay_of_weights(weights)
    stay, move = np.log(p), np.log((1 - p) / max(k - 1, 1))
    left, right = i[:, None] == i, j[:, None] == j
    return np.where(left & right, 2 * stay, np.where(left | right, stay + move, two)), homozygous


def logits_diploid(logits: np.ndarray, weights: np.ndarray, homozygous: float = -0.1, two: float = -1e6) -> np.ndarray:
    """Pairs of founders (two columns) of a model's logits: each slot stays or changes by itself, both at once
    at a prohibitive cost."""
    i, j = pairs(logits.shape[1])
    trans, homozygous = logits_transitions(weights, homozygous, two)
    path = viterbi(pair_emissions(log_softmax(logits), -homozygous), trans, np.full(len(i), -np.log(len(i))))
    return np.stack([i[path], j[path]], axis=1)


def crf_viterbi(emit: np.ndarray, cost: np.ndarray, switches: np.ndarray, stay_bonus: np.ndarray) -> np.ndarray:
    """Best path where a transition at site t costs ``cost[t]`` for each switch and staying earns a bonus."""
    n, s = emit.shape
    back = np.zeros((n, s), dtype=np.int32)
    score = emit[0].copy()
    for t in range(1, n):
        step = score[:, None] - cost[t] * switches
        step[np.arange(s), np.arange(s)] += stay_bonus
        back[t] = step.argmax(axis=0)
        score = step[back[t], np.arange(s)] + emit[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def crf_viterbi_factored(emit: np.ndarray, cost: np.ndarray, stay_bonus: np.ndarray, k: int) -> np.ndarray:
    """The same over unordered pairs in pairs + founders a step: a pair is reached by staying, from the best
    pair that holds one of its founders (one switch), or from the best of all (two). Ties in that order.

    Scores stand in a symmetric founder-by-founder table, so the best pair of a founder is its row's
    maximum; the first one in a row is the pair of the lowest number.
    """
    i, j = pairs(k)
    place = np.empty((k, k), dtype=np.int64)
    place[i, j] = place[j, i] = np.arange(len(i))
    n = len(emit)
    bonus = stay_bonus[place]
    own = np.arange(k * k, dtype=np.int32).reshape(k, k)
    rows = np.arange(k)
    first = rows * k
    came = np.empty((n, k, k), dtype=np.int16 if k <= 181 else np.int32)
    score = emit[0][place]
    for t in range(1, n):
        at = score.argmax(axis=1)
        best = score[rows, at]
        at = first + at
        top = best.argmax()
        c = cost[t]
        new = score + bonus
        source = own.copy()
        one = best - c
        for value, origin in ((one[:, None], at[:, None]), (one[None, :], at[None, :]), (best[top] - 2 * c, at[top])):
            more = value > new
            np.copyto(new, value, where=more)
            np.copyto(source, origin, where=more, casting="same_kind")
        came[t] = source
        score = new + emit[t][place]
    flat = score.argmax()
    path = np.empty(n, dtype=np.int64)
    for t in range(n - 1, -1, -1):
        a, b = divmod(int(flat), k)
        if a > b:  # the table is symmetric; sources are kept where the first founder is the lower
            a, b = b, a
        path[t] = place[a, b]
        flat = came[t, a, b]
    return path


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials along an axis."""
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _step(cost: float, switches: np.ndarray, stay_bonus: np.ndarray) -> np.ndarray:
    out = -cost * switches.astype(float)
    out[np.arange(len(out)), np.arange(len(out))] += stay_bonus
    return out


def crf_marginals(emit: np.ndarray, cost: np.ndarray, switches: np.ndarray, stay_bonus: np.ndarray) -> np.ndarray:
    """Log posterior of each state at each site, by forward and backward passes."""
    n, _ = emit.shape
    ahead, behind = emit.copy(), np.zeros_like(emit)
    for t in range(1, n):
        ahead[t] += log_sum(ahead[t - 1][:, None] + _step(cost[t], switches, stay_bonus), 0)
    for t in range(n - 2, -1, -1):
        behind[t] = log_sum(_step(cost[t + 1], switches, stay_bonus) + (behind[t + 1] + emit[t + 1])[None, :], 1)
    both = ahead + behind
    return both - log_sum(both, 1)[:, None]


def crf_nll(emit: np.ndarray, cost: np.ndarray, switches: np.ndarray, stay_bonus: np.ndarray, path: np.ndarray) -> float:
    """Negative log likelihood of a path."""
    ahead = emit[0].copy()
    score = emit[0, path[0]]
    for t in range(1, len(emit)):
        step = _step(cost[t], switches, stay_bonus)
        ahead = log_sum(ahead[:, None] + step, 0) + emit[t]
        score += step[path[t - 1], path[t]] + emit[t, path[t]]
    return float(log_sum(ahead, 0) - score)


def pruned(emit: np.ndarray, keep: np.ndarray, decode) -> np.ndarray:
    """Decode over the kept states only, in terms of all states."""
    states = np.flatnonzero(keep)
    return states[decode(emit[:, states])]


def crf_diploid(cells: np.ndarray, weights: np.ndarray, cost: float = 2.0, penalty: float = 0.0) -> np.ndarray:
    """Pairs of founders (two columns) where each switch costs alike; equal founders pay a penalty."""
    i, j = pairs(cells.shape[1])
    path = crf_viterbi_factored(pair_emissions(grid(log_softmax(cells * weights)), grid(penalty)), np.full(len(cells), grid(cost)), np.zeros(len(i)), cells.shape[1])
    return np.stack([i[path], j[path]], axis=1)


def _twice(path: np.ndarray) -> np.ndarray:
    return np.repeat(path[:, None], 2, axis=1)


#: Ways to decode a matrix of cells (or of logits) to two founders a site.
MODELS = {
    "hmm_haploid": lambda x, w: _twice(hmm_haploid(x, w)),
    "hmm_diploid": hmm_diploid,
    "logits_haploid": lambda x, w: _twice(logits_haploid(x, w)),
    "logits_diploid": logits_diploid,
    "crf_haploid": lambda x, w: _twice(crf_viterbi(grid(log_softmax(x * w)), np.full(len(x), 2.0), 1 - np.eye(x.shape[1]), np.zeros(x.shape[1]))),
    "crf_diploid": crf_diploid,
}


def decode(sites: DataFrame, keys: list[str], by: str, model: str, weights: list[float] | None = None, keep: str | None = None, **options) -> DataFrame:
    """keys, by, p1, p2: decoded founders. One group is one task's rows in order; a group holds one
    contig of one sample, or one window where contigs are cut into windows (see ``windows.sliding``).

    ``keep`` names a column of founder indices, alike in all rows of a group: only those are decoded (see
    ``order.present_or_best``). ``options`` go to the model; one given as a column's name is taken from
    each group, such as a penalty of each individual.
    """
    run = MODELS[model]
    fields = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, by]) + ", p1 int, p2 int"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by)
        cells = np.array(group["features"].tolist(), dtype=np.float64)
        states = np.array(sorted(group[keep].iloc[0])) if keep else np.arange(cells.shape[1])
        own = {name: float(group[value].iloc[0]) if isinstance(value, str) else value for name, value in options.items()}
        path = states[run(cells[:, states], (np.array(weights) if weights else np.ones(cells.shape[1]))[states], **own)]
        return group[[*keys, by]].assign(p1=path[:, 0].astype("int32"), p2=path[:, 1].astype("int32"))

    return sites.groupBy(*keys).applyInPandas(one, schema)


def posterior(sites: DataFrame, keys: list[str], by: str, cost: float = 2.0, diploid: bool = False) -> DataFrame:
    """keys, by, founder, log_p: the likeliest founder of each site by its posterior; p1 and p2 if ``diploid``."""
    fields = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, by]) + (", p1 int, p2 int" if diploid else ", founder int") + ", log_p double"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by)
        emit = log_softmax(np.array(group["features"].tolist(), dtype=np.float64))
        k = emit.shape[1]
        i, j = pairs(k)
        switches = 1 - np.eye(k)
        if diploid:
            ne = lambda a, b: (a[:, None] != b).astype(int)
            emit, switches = pair_emissions(emit), np.minimum(ne(i, i) + ne(j, j), ne(i, j) + ne(j, i))
        log_p = crf_marginals(emit, np.full(len(emit), cost), switches, np.zeros(emit.shape[1]))
        best = log_p.argmax(axis=1)
        found = {"p1": i[best].astype("int32"), "p2": j[best].astype("int32")} if diploid else {"founder": best.astype("int32")}
        return group[[*keys, by]].assign(**found, log_p=log_p[np.arange(len(best)), best])

    return sites.groupBy(*keys).applyInPandas(one, schema)


def predict(sites: DataFrame, keys: list[str], by: str, model) -> DataFrame:
    """Emissions by a user's model: ``model.predict(cells)`` maps a matrix of a group's cells to another."""
    fields = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, by]) + ", emissions array<double>"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by)
        return group[[*keys, by]].assign(emissions=list(np.asarray(model.predict(np.array(group["features"].tolist(), dtype=np.float64)), dtype=np.float64)))

    return sites.groupBy(*keys).applyInPandas(one, schema)


def softmax_array(values):
    """Softmax of an array column."""
    # bound by an array of one element, the largest value and the sum are computed once and not for each element
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    shifted = bind(F.struct(values.alias("v"), F.array_max(values).alias("top")), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))
    summed = bind(shifted, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, b: a + b).alias("total")))
    return bind(summed, lambda s: F.transform(s["e"], lambda x: x / s["total"]))
