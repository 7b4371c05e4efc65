"""SQL of model trees, for comparison: growth, ridge, pruning, smoothing and scores.

Growth and pruning are unrolled level by level, and the ridge systems by Gauss-Jordan elimination,
one feature at a time; what goes down a tree is recursive.
"""

from cashtide.modeltree.params import TreeParams
from cashtide.plans import daily_queries as DQ
from cashtide.plans.shared import DAILY_BY_CHANNEL
from cashtide.schemas import TARGETS, numeric_features_for

PARAMS = TreeParams()
QUANTILES = "[" + ", ".join(repr(q) for q in PARAMS.quantiles()) + "]"
NUMERICS = len(numeric_features_for(""))
#: Features of a model: its numerics and at most one for each order priority.
FEATURES = NUMERICS + 5
RIGHT = 99

ALL = DAILY_BY_CHANNEL.replace("SELECT channel, date", "SELECT 'ALL' AS channel, date").replace(
    "GROUP BY channel, date", "GROUP BY date"
)
SERIES = f"""{DQ.backfilled_sql(ALL, digits=None)},
counts AS (SELECT date, channel, count(*) AS n FROM staging GROUP BY ALL),
modes AS (SELECT date, channel AS channel_mode FROM counts QUALIFY row_number() OVER
  (PARTITION BY date ORDER BY n DESC, channel) = 1),
tgt AS (SELECT date, {DQ.target_sql(True)} FROM daily
  WINDOW w AS (PARTITION BY channel ORDER BY date)),
full_rows AS (SELECT f.* EXCLUDE (channel), m.channel_mode, t.* EXCLUDE (date)
  FROM feat f JOIN modes m USING (date) JOIN tgt t USING (date))"""


def per_target(select):
    """UNION ALL of one SELECT per target; ``select`` maps a target to SQL."""
    return " UNION ALL ".join(select(target) for target in TARGETS)


def long_features(target, every=False):
    """(model_id, date, y, feature, value) for the numeric features of one target."""
    known = "" if every else f" WHERE {target} IS NOT NULL"
    return " UNION ALL ".join(
        f"SELECT '{target}' AS model_id, date, {target} AS y, {i} AS feature, "
        f"CAST({name} AS DOUBLE) AS value FROM full_rows{known}"
        for i, name in enumerate(numeric_features_for(target))
    )


def _seasonal():
    """The series with its daily amounts scaled by weekday and pay day."""
    factor = (
        "CASE WHEN isodow(date) >= 6 THEN CAST(0.2 AS DECIMAL(3,2)) ELSE 1 END * CASE WHEN day(date) "
        "IN (15, 25, 26, 27, 28, 29, 30, 31) THEN CAST(1.5 AS DECIMAL(3,2)) ELSE 1 END"
    )
    scaled = ", ".join(
        f"CAST(CAST({c} AS DECIMAL(28,2)) * ({factor}) AS DECIMAL(38,2)) AS {c}"
        for c in ("cash_in", "cash_out")
    )
    whole = ALL.replace("daily AS (", "plain AS (") + (
        f", daily AS (SELECT channel, date, {scaled}, transaction_count FROM plain)"
    )
    return SERIES.replace(ALL, whole)


#: Rows that each target looks ahead.
AHEAD = {t: 1 if "next_day" in t else 7 if "h7" in t else 30 for t in TARGETS}


def _plain():
    """All days with the target of those that have one, and the models' rows."""
    return [f"raw AS MATERIALIZED ({per_target(lambda t: long_features(t, every=True))})"]


def _folds(folds):
    """The same for each fold: targets that are known before its cut."""
    known = ", ".join(f"lead(date, {n}) OVER (ORDER BY date) AS known{n}" for n in sorted(set(AHEAD.values())))
    which = " ".join(f"WHEN '{t}' THEN known{n}" for t, n in AHEAD.items())
    span = "min(date) + CAST(floor((max(date) - min(date) + 1) * {0} / {1}.0) AS INTEGER)"
    return [
        f"whole AS MATERIALIZED ({per_target(lambda t: long_features(t, every=True))})",
        f"known AS (SELECT date, {known} FROM full_rows)",
        f"cuts AS (SELECT k, {span.format('k', folds + 1)} AS since, {span.format('(k + 1)', folds + 1)} "
        f"AS until FROM full_rows, range(1, {folds + 1}) r(k) GROUP BY k)",
        "raw AS MATERIALIZED (SELECT k || '~' || model_id AS model_id, w.date, CASE WHEN CASE model_id "
        f"{which} END < since THEN y END AS y, feature, value FROM whole w JOIN known USING (date), cuts)",
    ]


def _rows(seasonal, folds=0):
    """Scaled features of all days, and the target of those that have one."""
    return [
        _seasonal() if seasonal else SERIES,
        *(_folds(folds) if folds else _plain()),
        "stats AS MATERIALIZED (SELECT model_id, feature, avg(value) AS mean, stddev_pop(value) AS sd "
        "FROM raw WHERE y IS NOT NULL GROUP BY ALL)",
        "channels AS (SELECT model_id, c, row_number() OVER (PARTITION BY model_id ORDER BY c) AS at "
        "FROM (SELECT DISTINCT model_id, channel_mode AS c FROM raw JOIN full_rows USING (date) "
        "WHERE feature = 0 AND y IS NOT NULL))",
        f"hot AS MATERIALIZED (SELECT r.model_id, r.date, {NUMERICS - 1} + c.at AS feature, "
        "CASE WHEN f.channel_mode = c.c THEN 1.0 ELSE 0.0 END AS value, 'channel_' || c.c AS name "
        "FROM raw r JOIN full_rows f USING (date) JOIN channels c USING (model_id) WHERE r.feature = 0)",
        "x AS MATERIALIZED (SELECT r.model_id, r.date, r.feature, (r.value - s.mean) / "
        "CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END AS value FROM raw r JOIN stats s "
        "USING (model_id, feature) UNION ALL SELECT model_id, date, feature, value FROM hot)",
        "y_means AS (SELECT model_id, avg(y) AS y_mean FROM raw WHERE feature = 0 GROUP BY ALL)",
        "at0 AS MATERIALIZED (SELECT model_id, date, 1 AS node_id, y - avg(y) OVER (PARTITION BY "
        "model_id) AS y FROM raw WHERE feature = 0 AND y IS NOT NULL)",
        "nodes0 AS MATERIALIZED (SELECT model_id, 1 AS node_id, count(*) AS n, 0.0 AS mean, "
        "stddev_pop(y) AS sd FROM at0 GROUP BY model_id)",
    ]


def _level(d, least):
    """One level of growth."""
    return [
        f"in{d} AS MATERIALIZED (SELECT a.model_id, a.date, a.node_id, a.y - n.mean AS y, n.sd, "
        f"n.mean, n.n FROM at{d} a JOIN nodes{d} n USING (model_id, node_id) "
        "WHERE n.n >= 8 AND n.sd >= 1e-10)",
        f"v{d} AS MATERIALIZED (SELECT i.*, x.feature, x.value FROM in{d} i JOIN x "
        "USING (model_id, date))",
        f"th{d} AS (SELECT DISTINCT model_id, node_id, feature, threshold FROM (SELECT model_id, "
        f"node_id, feature, unnest(quantile_cont(value, {QUANTILES})) AS threshold FROM v{d} "
        "GROUP BY model_id, node_id, feature HAVING max(value) > min(value)))",
        f"sides{d} AS (SELECT t.model_id, t.node_id, t.feature, t.threshold, any_value(v.n) AS n, "
        "any_value(v.sd) AS sd, count(*) FILTER (v.value <= t.threshold) AS n_left, "
        "coalesce(stddev_pop(v.y) FILTER (v.value <= t.threshold), 0) AS sd_left, "
        "coalesce(stddev_pop(v.y) FILTER (v.value > t.threshold), 0) AS sd_right "
        f"FROM th{d} t JOIN v{d} v ON v.model_id = t.model_id AND v.node_id = t.node_id "
        "AND v.feature = t.feature GROUP BY 1, 2, 3, 4)",
        f"best{d} AS MATERIALIZED (SELECT * FROM (SELECT *, sd - (n_left / n * sd_left + "
        f"(n - n_left) / n * sd_right) AS sdr FROM sides{d} WHERE n_left >= 4 AND n - n_left >= 4) "
        "QUALIFY row_number() OVER (PARTITION BY model_id, node_id ORDER BY "
        "round(sdr / greatest(sd, 1e-10), 11) DESC, feature, threshold) = 1)",
        f"cut{d} AS MATERIALIZED (SELECT * FROM best{d} WHERE sdr >= {least} * sd)",
        f"at{d + 1} AS MATERIALIZED (SELECT v.model_id, v.date, v.node_id * 2 + "
        "CASE WHEN v.value <= c.threshold THEN 0 ELSE 1 END AS node_id, v.y + v.mean AS y "
        f"FROM v{d} v JOIN cut{d} c ON c.model_id = v.model_id AND c.node_id = v.node_id "
        "AND c.feature = v.feature)",
        f"nodes{d + 1} AS MATERIALIZED (SELECT model_id, node_id, count(*) AS n, avg(y) AS mean, "
        f"stddev_pop(y) AS sd FROM at{d + 1} GROUP BY ALL)",
    ]


def _union(select, numbers):
    return " UNION ALL ".join(select(d) for d in numbers)


def _grown(params, seasonal, folds=0):
    depth = params.max_depth
    steps = _rows(seasonal, folds)
    for d in range(depth):
        steps += _level(d, params.min_std_reduction)
    grown = _union(lambda d: f"SELECT model_id, node_id, n, mean, sd FROM nodes{d}", range(depth + 1))
    return [*steps, f"grown AS MATERIALIZED ({grown})"]


def _ridge(depth, alpha):
    """Ridge coefficients, level and squared error of every grown node."""
    every = _union(lambda d: f"SELECT model_id, node_id, date, y FROM at{d}", range(depth + 1))
    steps = [
        f"every AS MATERIALIZED ({every})",
        "w AS MATERIALIZED (SELECT e.model_id, e.node_id, e.date, x.feature, x.value, "
        "x.value - avg(x.value) OVER f AS z, e.y - avg(e.y) OVER f AS yc, "
        "max(x.value) OVER f - min(x.value) OVER f > 2e-10 AS varies "
        "FROM every e JOIN x USING (model_id, date) "
        "WINDOW f AS (PARTITION BY e.model_id, e.node_id, x.feature))",
        "counted AS (SELECT model_id, node_id, count(DISTINCT feature) FILTER (varies) AS u, "
        "count(*) FILTER (feature = 0) AS n FROM w GROUP BY ALL)",
        "used AS MATERIALIZED (SELECT model_id, node_id, n, CASE WHEN n >= u + 1 THEN u ELSE 0 END "
        "AS used FROM counted)",
        "m AS MATERIALIZED (SELECT w.* FROM w JOIN used USING (model_id, node_id) "
        "WHERE varies AND used > 0)",
        f"g0 AS MATERIALIZED (SELECT a.model_id, a.node_id, a.feature AS i, b.feature AS j, "
        f"sum(a.z * b.z) + CASE WHEN a.feature = b.feature THEN {alpha} ELSE 0 END AS v "
        "FROM m a JOIN m b ON a.model_id = b.model_id AND a.node_id = b.node_id AND a.date = b.date "
        "GROUP BY a.model_id, a.node_id, a.feature, b.feature "
        f"UNION ALL SELECT model_id, node_id, feature, {RIGHT}, sum(z * yc) FROM m GROUP BY ALL)",
    ]
    node = "PARTITION BY model_id, node_id"
    for k in range(FEATURES):
        steps.append(
            f"g{k + 1} AS MATERIALIZED (SELECT model_id, node_id, i, j, CASE WHEN p IS NULL THEN v "
            f"WHEN i = {k} THEN v / p ELSE v - c * r / p END AS v FROM (SELECT *, "
            f"max(CASE WHEN i = {k} AND j = {k} THEN v END) OVER ({node}) AS p, "
            f"max(CASE WHEN i = {k} THEN v END) OVER ({node}, j) AS r, "
            f"max(CASE WHEN j = {k} THEN v END) OVER ({node}, i) AS c FROM g{k}))"
        )
    steps += [
        f"beta AS MATERIALIZED (SELECT model_id, node_id, i AS feature, v AS b FROM g{FEATURES} "
        f"WHERE j = {RIGHT})",
        "middle AS (SELECT model_id, node_id, feature, avg(value) AS value FROM w GROUP BY ALL)",
        "slope AS (SELECT model_id, node_id, sum(b * value) AS s FROM beta JOIN middle "
        "USING (model_id, node_id, feature) GROUP BY ALL)",
        "level AS MATERIALIZED (SELECT e.model_id, e.node_id, avg(e.y) - coalesce(any_value(s), 0) + "
        "any_value(y_mean) AS level FROM every e LEFT JOIN slope s USING (model_id, node_id) "
        "JOIN y_means USING (model_id) GROUP BY ALL)",
        "misses AS (SELECT w.model_id, w.node_id, w.date, any_value(yc) - coalesce(sum(z * b), 0) AS "
        "miss FROM w LEFT JOIN beta USING (model_id, node_id, feature) GROUP BY ALL)",
        "err AS MATERIALIZED (SELECT model_id, node_id, any_value(u.n) AS n, any_value(used) AS used, "
        "avg(miss * miss) * (1 + 2.0 * (any_value(used) + 1) / any_value(u.n)) AS error "
        "FROM misses JOIN used u USING (model_id, node_id) GROUP BY ALL)",
    ]
    return steps


def _pruned(depth):
    """Nodes that stay, from the deepest up."""
    steps = [f"b{depth} AS MATERIALIZED (SELECT *, true AS leaf, error AS best FROM err "
             f"WHERE node_id >= {2**depth})"]  # fmt: skip
    for d in range(depth - 1, -1, -1):
        steps.append(
            f"b{d} AS MATERIALIZED (SELECT e.*, below IS NULL OR error <= below AS leaf, "
            "CASE WHEN below < error THEN below ELSE error END AS best FROM err e LEFT JOIN "
            "(SELECT model_id, node_id // 2 AS node_id, sum(n * best) / sum(n) AS below "
            f"FROM b{d + 1} GROUP BY ALL) c USING (model_id, node_id) "
            f"WHERE node_id BETWEEN {2**d} AND {2 ** (d + 1) - 1})"
        )
    judged = _union(lambda d: f"SELECT *, {d} AS depth FROM b{d}", range(depth + 1))
    steps += [
        f"judged AS MATERIALIZED ({judged})",
        "reached AS (SELECT * FROM judged WHERE node_id = 1 UNION ALL SELECT j.* FROM reached r "
        "JOIN judged j ON j.model_id = r.model_id AND j.node_id // 2 = r.node_id AND NOT r.leaf)",
    ]
    splits = _union(
        lambda d: f"SELECT model_id, node_id, feature, threshold, sdr FROM cut{d}", range(depth)
    )
    return [
        *steps,
        f"splits AS ({splits})",
        f"kept AS MATERIALIZED (SELECT k.*, g.sd, s.* EXCLUDE (model_id, node_id) FROM reached k "
        "JOIN grown g USING (model_id, node_id) LEFT JOIN splits s ON s.model_id = k.model_id "
        "AND s.node_id = k.node_id AND NOT k.leaf)",
        "names AS (SELECT DISTINCT model_id, feature, name FROM hot UNION ALL "
        + per_target(
            lambda t: " UNION ALL ".join(
                f"SELECT '{t}', {i}, '{name}'" for i, name in enumerate(numeric_features_for(t))
            )
        )
        + ")",
    ]


def _scored(smoothing):
    """Raw and smoothed predictions of all days."""
    return [
        "paths AS (SELECT model_id, date, 1 AS node_id FROM x WHERE feature = 0 UNION ALL "
        "SELECT r.model_id, r.date, r.node_id * 2 + CASE WHEN x.value <= k.threshold THEN 0 ELSE 1 END "
        "FROM paths r JOIN kept k ON k.model_id = r.model_id AND k.node_id = r.node_id AND NOT k.leaf "
        "JOIN x ON x.model_id = r.model_id AND x.date = r.date AND x.feature = k.feature)",
        "added AS (SELECT p.model_id, p.date, p.node_id, sum(x.value * b.b) AS s FROM paths p JOIN beta b "
        "ON b.model_id = p.model_id AND b.node_id = p.node_id JOIN x ON x.model_id = p.model_id "
        "AND x.date = p.date AND x.feature = b.feature GROUP BY ALL)",
        "valued AS MATERIALIZED (SELECT p.*, k.leaf, k.n, l.level + coalesce(a.s, 0) AS v FROM paths p "
        "JOIN kept k USING (model_id, node_id) JOIN level l USING (model_id, node_id) "
        "LEFT JOIN added a USING (model_id, date, node_id))",
        "scored AS MATERIALIZED (SELECT model_id, date, max(node_id) AS node_id, "
        "max(v) FILTER (leaf) AS raw, "
        f"sum(CASE WHEN leaf THEN n ELSE {smoothing} END * v) / "
        f"sum(CASE WHEN leaf THEN n ELSE {smoothing} END) AS smooth FROM valued GROUP BY ALL)",
        "trained AS (SELECT s.*, r.y FROM scored s JOIN raw r ON r.model_id = s.model_id "
        "AND r.date = s.date AND r.feature = 0 WHERE r.y IS NOT NULL)",
    ]


def grown_sql(select, params=PARAMS, seasonal=True):
    return f"WITH {', '.join(_grown(params, seasonal))} {select}"


def tree_sql(select, params=PARAMS, seasonal=True, folds=0):
    depth = params.max_depth
    steps = _grown(params, seasonal, folds) + _ridge(depth, params.ridge_alpha) + _pruned(depth)
    steps += _scored(params.smoothing)
    return f"WITH RECURSIVE {', '.join(steps)} {select}"


NODES = """SELECT model_id, node_id, CAST(n AS BIGINT) AS n, round(mean, 2) AS mean,
  round(sd, 2) AS sd FROM grown"""

RIDGE = """SELECT b.model_id, b.node_id, CAST(b.feature AS INTEGER) AS feature, names.name,
  CAST(k.n AS BIGINT) AS n, CAST(k.used AS INTEGER) AS used, round(b.b) + 0.0 AS coef,
  round(l.level, -1) + 0.0 AS level
FROM beta b JOIN kept k ON k.model_id = b.model_id AND k.node_id = b.node_id
  JOIN level l ON l.model_id = b.model_id AND l.node_id = b.node_id
  JOIN names ON names.model_id = b.model_id AND names.feature = b.feature"""

PRUNED = """SELECT model_id, node_id, CAST(depth AS INTEGER) AS depth, leaf AS is_leaf,
  round(best / 1e6) AS error, CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold,
  round(sdr, 2) AS sdr, round(sd, 2) AS sd, CAST(n AS BIGINT) AS n FROM kept"""

STATS = """SELECT model_id, CAST(max(depth) AS INTEGER) AS depth, count(*) FILTER (leaf) AS leaves,
  count(*) AS nodes, any_value(g.n) AS nodes_grown
FROM kept JOIN (SELECT model_id, count(*) AS n FROM grown GROUP BY ALL) g USING (model_id) GROUP BY ALL"""


def predicted(column):
    return (
        "SELECT model_id, CAST(date AS VARCHAR) AS row_id, y, CAST(node_id AS INTEGER) AS node_id, "
        f"round({column}, -2) + 0.0 AS prediction FROM trained"
    )


PREDICTED_ALL = (
    "SELECT date, "
    + ", ".join(
        f"round(max(CASE WHEN model_id = '{t}' THEN greatest(smooth, 0) END), -2) + 0.0 AS {t}"
        for t in TARGETS
    )
    + " FROM scored GROUP BY date"
)

IMPORTANCES = """SELECT model_id, CAST(feature AS INTEGER) AS feature, name,
  round(importance, 9) AS importance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY importance DESC, feature) AS rank FROM (
    SELECT n.model_id, n.feature, n.name, CASE WHEN sum(coalesce(gain, 0)) OVER m > 0
      THEN coalesce(gain, 0) / sum(coalesce(gain, 0)) OVER m ELSE 0 END AS importance
    FROM names n LEFT JOIN (SELECT model_id, feature, sum(sdr * n) AS gain FROM kept WHERE NOT leaf
      GROUP BY ALL) g ON g.model_id = n.model_id AND g.feature = n.feature
    WINDOW m AS (PARTITION BY n.model_id))) WHERE rank <= 10"""

FOLDS = """SELECT s.model_id, count(*) AS n, round(sqrt(avg((w.y - smooth) * (w.y - smooth))), -1) AS rmse,
  round(1 - avg((w.y - smooth) * (w.y - smooth)) / var_pop(w.y), 6) AS r2,
  round(avg(abs(w.y - smooth)), -1) AS mae
FROM scored s JOIN cuts ON s.model_id LIKE k || '~%'
JOIN whole w ON s.model_id = k || '~' || w.model_id AND w.date = s.date AND w.feature = 0
WHERE w.y IS NOT NULL AND s.date >= since AND s.date < until GROUP BY s.model_id"""

METRICS = """SELECT model_id, count(*) AS n, round(sqrt(avg((y - smooth) * (y - smooth))), -1) AS rmse,
  round(1 - avg((y - smooth) * (y - smooth)) / var_pop(y), 6) AS r2,
  round(avg(abs(y - smooth)), -1) AS mae FROM trained GROUP BY model_id"""

#: A leaf's conditions, one for each node above it, and its equation with whole coefficients.
RULES = """SELECT k.model_id, k.node_id, CAST(k.n AS BIGINT) AS n, coalesce(c.condition, 'ROOT') AS
  condition, CASE WHEN k.used = 0 THEN printf('%.0f', l.level) || ' (constant)'
  ELSE t.terms || ' + ' || printf('%.0f', l.level) END AS equation
FROM kept k JOIN level l ON l.model_id = k.model_id AND l.node_id = k.node_id
LEFT JOIN (SELECT b.model_id, b.node_id, string_agg(name || '=' || printf('%.0f', b), ', ' ORDER BY
    b.feature) AS terms FROM beta b JOIN names ON names.model_id = b.model_id
    AND names.feature = b.feature GROUP BY ALL) t ON t.model_id = k.model_id AND t.node_id = k.node_id
LEFT JOIN (SELECT s.model_id, s.leaf, string_agg(names.name || CASE WHEN s.step % 2 = 0 THEN ' ≤ '
    ELSE ' > ' END || printf('%.3f', p.threshold), ' AND ' ORDER BY s.step) AS condition
  FROM (SELECT model_id, node_id AS leaf, node_id >> i AS step FROM kept, range(0, 11) r(i)
    WHERE leaf AND node_id >> i > 1) s
  JOIN kept p ON p.model_id = s.model_id AND p.node_id = s.step // 2
  JOIN names ON names.model_id = p.model_id AND names.feature = p.feature GROUP BY ALL) c
  ON c.model_id = k.model_id AND c.leaf = k.node_id
WHERE k.leaf"""

SAVED = " UNION ALL ".join(
    f"SELECT '{part}' AS part, count(*) AS rows, true AS same, true AS found FROM ({rows})"
    for part, rows in (
        ("nodes", "SELECT 1 FROM kept"),
        ("models", "SELECT DISTINCT model_id FROM kept"),
        ("grown", "SELECT 1 FROM grown"),
        ("names", "SELECT 1 FROM names"),
        ("effects", f"SELECT 1 FROM beta WHERE feature >= {NUMERICS}"),
        ("lookup", f"SELECT 1 FROM names WHERE feature >= {NUMERICS}"),
    )
)
