"""Plain Python versions of the operators, for small panels."""

from __future__ import annotations

import math
import random

import numpy as np


def random_panel(seed, species=3, areas=("A", "B", "C"), years=range(-5, 25), hole=0.4, skip=0.15):
    """Rows with missing years, missing cells and NULL values."""
    rng = random.Random(seed)
    rows = []
    for s in range(species):
        kept = [y for y in years if rng.random() > skip]
        for a in areas:
            for y in kept:
                if a in areas[:2] and rng.random() < hole:
                    continue
                value = None if rng.random() < 0.05 else round(rng.uniform(5, 50), 2)
                var = None if value is None or rng.random() < 0.1 else round(rng.uniform(0.5, 9), 2)
                rows.append((f"s{s}", y, a, value, var, None if value is None else 3 * value + 1, var))
    return rows


def grid(rows):
    """``{(species, area): [(year, values or None)]}`` over the species' observed years."""
    years, series, cell = {}, {}, {}
    for s, y, a, *v in rows:
        years.setdefault(s, set()).add(y)
        series[s, a] = None
        cell[s, a, y] = v
    return {(s, a): [(y, cell.get((s, a, y))) for y in sorted(years[s])] for s, a in series}


def interpolate(xs, vs, maxgap):
    known = [i for i, v in enumerate(vs) if v is not None]
    if len(known) < 2:
        return list(vs)
    out = list(vs)
    i = 0
    while i < len(vs):
        if vs[i] is not None:
            i += 1
            continue
        j = i
        while j < len(vs) and vs[j] is None:
            j += 1
        if j - i <= maxgap:
            for k in range(i, j):
                if i == 0:
                    out[k] = vs[j]
                elif j == len(vs):
                    out[k] = vs[i - 1]
                else:
                    share = (xs[k] - xs[i - 1]) / (xs[j] - xs[i - 1])
                    out[k] = vs[i - 1] + (vs[j] - vs[i - 1]) * share
        i = j
    return out


def ratio_fill(rows, targets, reference, start, early_cv=0.05):
    """Values and variances of the first measure after the ratio fill."""
    ref = {}
    for s, y, a, v, *_ in rows:
        if isinstance(reference, str):
            if a == reference:
                ref[s, y] = v
        elif a not in targets:
            ref[s, y] = ref.get((s, y), 0.0) + (v or 0.0)
    prev = {}
    for s in {s for s, _ in ref}:
        years = sorted(y for t, y in ref if t == s)
        for i, y in enumerate(years):
            prev[s, y] = ref[s, years[max(i - 1, 0)]]
    out = {}
    for (s, a), cells in grid(rows).items():
        cvs = [
            math.sqrt(v[1]) / v[0] for _, v in cells if v and v[0] is not None and v[1] is not None
        ]
        mean = sum(cvs) / len(cvs) if cvs else 0.0
        for i, (y, v) in enumerate(cells):
            value, var = (v[0], v[1]) if v else (None, None)
            before = cells[max(i - 1, 0)][1]
            before = before[0] if before else None
            if a in targets and value is None:
                now, then = ref.get((s, y)), prev.get((s, y))
                if before is not None and now is not None and then:
                    value = before * (now / then)
            if a in targets and y >= start and value is not None and var is None:
                var = (mean * value) ** 2
            if y >= start:
                out[s, a, y] = (value, var)
    return out


def dense_model(ys, rs, pe, rho):
    """Objective, smoothed means and variances from the joint normal distribution."""
    n = len(ys)
    t = np.arange(n)
    cov = pe**2 * rho ** np.abs(t[:, None] - t[None, :])
    seen = [i for i, y in enumerate(ys) if y is not None]
    if not seen:
        return 0.0, np.zeros(n), np.diag(cov)
    y = np.array([ys[i] for i in seen])
    s = cov[np.ix_(seen, seen)] + np.diag([rs[i] for i in seen])
    inv = np.linalg.inv(s)
    nll = 0.5 * (y @ inv @ y + np.linalg.slogdet(s)[1] + len(seen) * math.log(2 * math.pi))
    cross = cov[:, seen]
    return nll, cross @ inv @ y, np.diag(cov - cross @ inv @ cross.T)
