"""A small model tree in numpy, written for the tests only, to check the Spark jobs against.

Nodes are stored in a dict keyed by heap number (root 1, children 2i and 2i + 1).
"""

import numpy as np


def ridge(x, y, alpha):
    """Coefficients of the varying columns, intercept, and their indices."""
    cols = np.flatnonzero(x.std(axis=0) > 1e-10)
    if cols.size == 0 or len(y) <= cols.size:
        return np.zeros(x.shape[1]), y.mean(), cols[:0]
    z = x[:, cols]
    zc = z - z.mean(axis=0)
    beta = np.linalg.lstsq(
        np.vstack([zc, np.sqrt(alpha) * np.eye(cols.size)]),
        np.concatenate([y - y.mean(), np.zeros(cols.size)]),
        rcond=None,
    )[0]
    coef = np.zeros(x.shape[1])
    coef[cols] = beta
    return coef, y.mean() - z.mean(axis=0) @ beta, cols


def find_split(x, y, p):
    options = []
    for f in range(x.shape[1]):
        v = x[:, f]
        if v.std() < 1e-10:
            continue
        for t in np.unique(np.quantile(v, p.quantiles())):
            left = v <= t
            sizes = left.sum(), (~left).sum()
            if min(sizes) >= p.min_samples_leaf:
                inner = (sizes[0] * y[left].std() + sizes[1] * y[~left].std()) / len(y)
                gain = y.std() - inner
                options.append((-round(gain / y.std(), 11), f, t, gain))
    return min(options) if options else None


def fit(x, y, p):
    nodes, work = {}, [(1, np.arange(len(y)))]
    while work:
        number, rows = work.pop()
        xs, ys = x[rows], y[rows]
        coef, intercept, cols = ridge(xs, ys, p.ridge_alpha)
        node = {"n": len(rows), "coef": coef, "intercept": intercept, "mean": ys.mean()}
        miss = ys - xs @ coef - intercept
        raw = np.abs(miss).mean() if p.pruning_method == "mae" else (miss**2).mean()
        node["error"] = raw * (1 + p.pruning_factor * (len(cols) + 1) / len(rows))
        nodes[number] = node
        deep = number.bit_length() - 1 >= p.max_depth
        if deep or len(rows) < 2 * p.min_samples_leaf or ys.std() < 1e-10:
            continue
        found = find_split(xs, ys, p)
        if found and found[3] >= p.min_std_reduction * ys.std():
            node.update(feature=found[1], threshold=found[2], sdr=found[3])
            left = xs[:, found[1]] <= found[2]
            work += [(2 * number, rows[left]), (2 * number + 1, rows[~left])]
    return nodes


def prune(nodes):
    """Set ``leaf`` on every node that ends a path; returns the numbers still reachable."""
    best = {}
    for number in sorted(nodes, reverse=True):
        node, kids = nodes[number], [2 * number, 2 * number + 1]
        node["leaf"] = "feature" not in node
        best[number] = node["error"]
        if not node["leaf"]:
            weights = [nodes[k]["n"] for k in kids]
            below = np.average([best[k] for k in kids], weights=weights)
            node["leaf"] = node["error"] <= below
            best[number] = min(node["error"], below)
    return reachable(nodes)


def reachable(nodes):
    kept, work = set(), [1]
    while work:
        number = work.pop()
        kept.add(number)
        if not nodes[number].get("leaf", "feature" not in nodes[number]):
            work += [2 * number, 2 * number + 1]
    return kept


def predict(nodes, x, k=None):
    """Step-by-step smoothing towards the root when ``k`` is given."""
    out = []
    for row in x:
        path = [1]
        while not nodes[path[-1]].get("leaf", "feature" not in nodes[path[-1]]):
            node = nodes[path[-1]]
            path.append(2 * path[-1] + int(row[node["feature"]] > node["threshold"]))
        values = [nodes[n]["intercept"] + row @ nodes[n]["coef"] for n in path]
        value, weight = values[-1], nodes[path[-1]]["n"]
        if k is not None:
            for above in reversed(values[:-1]):
                value = (weight * value + k * above) / (weight + k)
                weight += k
        out.append(value)
    return np.array(out)
