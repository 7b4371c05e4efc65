"""Spark model trees against the numpy tree, and invariants."""

import datetime
from dataclasses import replace

import brute_tree as B
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cashtide.modeltree import prep as P
from cashtide.modeltree import split as S
from cashtide.modeltree import train as T
from cashtide.modeltree.params import TreeParams
from cashtide.operators import features as X
from cashtide.schemas import FEATURES_IN, FEATURES_OUT, TARGETS
from cashtide.session import fresh_dir

CHANNELS = ["ATM", "ONLINE", "POS"]
PARAMS = TreeParams(max_depth=5)


def step_data(n=400, seed=0):
    """Numerics with steps, so that a tree has something to find, and a channel."""
    rng = np.random.default_rng(seed)
    num = np.round(rng.normal(size=(n, P.WIDTH)), 3)
    num[:, 6] = rng.integers(0, 7, n)
    num[:, 7] = num[:, 6] >= 5
    num[:, 8] = 0.0
    channel = rng.choice(CHANNELS, n)
    y = (
        1e6
        + 5e5 * (num[:, 6] >= 5)
        + 2e5 * np.where(num[:, 0] > 0.3, num[:, 1], -2 * num[:, 2])
        + 3e5 * (channel == "POS") * (num[:, 3] > 0)
        + rng.normal(scale=2e4, size=n)
    )
    return num, channel, y


def rows_frame(spark, models):
    pdf = pd.concat(
        pd.DataFrame(
            {
                "model_id": name,
                "row_id": [f"{i:05d}" for i in range(len(y))],
                "y": y,
                "num": [v.tolist() for v in num],
                "channel": channel,
            }
        )
        for name, (num, channel, y) in models.items()
    )
    schema = "model_id string, row_id string, y double, num array<double>, channel string"
    return spark.createDataFrame(pdf, schema)


def encoded(num, channel):
    sd = num.std(axis=0)
    hot = np.array([[float(c == k) for k in CHANNELS] for c in channel])
    return np.hstack([(num - num.mean(axis=0)) / np.where(sd == 0, 1, sd), hot])


@pytest.fixture(scope="module")
def data():
    return {"a~x_in": step_data(seed=1), "b~x_out": step_data(n=150, seed=2)}


@pytest.fixture(scope="module")
def fitted(spark, data):
    return T.fit(rows_frame(spark, data), PARAMS)


def predictions(model, rows, smooth=True):
    got = model.predict(rows, smooth).select("model_id", "row_id", "prediction").toPandas()
    got = got.sort_values("row_id")
    return {name: part["prediction"].to_numpy() for name, part in got.groupby("model_id")}


def test_same_tree_as_numpy(fitted, data):
    nodes = fitted.nodes.toPandas()
    grown = fitted.grown.toPandas()
    terms = fitted.coefficients().toPandas()
    for name, (num, channel, y) in data.items():
        x = encoded(num, channel)
        tree = B.fit(x, y - y.mean(), PARAMS)
        assert set(grown.loc[grown.model_id == name, "node_id"]) == set(tree)
        kept = B.prune(tree)
        mine = nodes[nodes.model_id == name].set_index("node_id")
        assert set(mine.index) == kept and len(kept) > 1
        for number in kept:
            row, ref = mine.loc[number], tree[number]
            assert row["n"] == ref["n"]
            assert row["is_leaf"] == ref["leaf"]
            mine_coef = np.zeros(x.shape[1])
            own = terms[(terms.model_id == name) & (terms.node_id == number)]
            mine_coef[own["feature"].to_numpy(int)] = own["value"]
            np.testing.assert_allclose(mine_coef, ref["coef"], rtol=1e-6, atol=1e-3)
            np.testing.assert_allclose(row["level"], ref["intercept"] + y.mean(), rtol=1e-9)
            if not ref["leaf"]:
                assert row["feature"] == ref["feature"]
                assert row["threshold"] == pytest.approx(ref["threshold"], rel=1e-9, abs=1e-12)
                assert row["sdr"] == pytest.approx(ref["sdr"], rel=1e-9)


@pytest.mark.parametrize("smooth", [True, False])
def test_same_predictions_as_numpy(spark, fitted, data, smooth):
    got = predictions(fitted, rows_frame(spark, data), smooth)
    for name, (num, channel, y) in data.items():
        x = encoded(num, channel)
        tree = B.fit(x, y - y.mean(), PARAMS)
        B.prune(tree)
        expected = y.mean() + B.predict(tree, x, PARAMS.smoothing if smooth else None)
        np.testing.assert_allclose(got[name], expected, rtol=1e-8)


def test_mae_pruning_and_no_pruning(spark, data):
    rows = rows_frame(spark, data)
    by_mae = T.fit(rows, replace(PARAMS, pruning_method="mae")).nodes.toPandas()
    whole = T.fit(rows, replace(PARAMS, prune=False)).nodes.toPandas()
    for name, (num, channel, y) in data.items():
        tree = B.fit(encoded(num, channel), y - y.mean(), replace(PARAMS, pruning_method="mae"))
        assert set(whole.loc[whole.model_id == name, "node_id"]) == set(tree)
        assert set(by_mae.loc[by_mae.model_id == name, "node_id"]) == B.prune(tree)


def test_depth_limit(spark, data):
    nodes = T.fit(rows_frame(spark, data), replace(PARAMS, max_depth=1, prune=False)).nodes
    assert nodes.agg(F.max("depth")).first()[0] == 1


def test_thresholds_are_numpy_percentiles(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=101), 1)
    wide = [[float(a)] + [0.0] * (P.WIDTH - 1) for a in v]
    pdf = pd.DataFrame({"y": rng.normal(size=101), "x": wide})
    located = spark.createDataFrame(pdf).selectExpr("'m' model_id", "1 node_id", "y", "x")
    got = S.candidates(S.with_bands(located), PARAMS).filter("feature = 0").toPandas()
    np.testing.assert_allclose(
        np.unique(got["threshold"]), np.unique(np.quantile(v, PARAMS.quantiles())), atol=1e-12
    )


def test_constant_target_is_one_leaf(spark):
    num, channel, _ = step_data(60)
    nodes = T.fit(rows_frame(spark, {"c": (num, channel, np.full(60, 5e6))})).nodes.collect()
    assert len(nodes) == 1 and nodes[0].level == pytest.approx(5e6)


def test_few_rows_give_a_constant(spark):
    num, channel, y = step_data(6)
    model = T.fit(rows_frame(spark, {"c": (num, channel, y)}))
    node = model.nodes.first()
    assert node.used == 0 and node.level == pytest.approx(y.mean())
    assert model.rules().first().equation.endswith("(constant)")


def test_importances_and_stats(fitted):
    top = fitted.top_importances(10).toPandas()
    assert (top.groupby("model_id").size() == 10).all()
    whole = fitted.top_importances(100).toPandas()
    np.testing.assert_allclose(whole.groupby("model_id")["importance"].sum(), 1.0)
    stats = fitted.stats().toPandas()
    assert (stats["nodes"] == 2 * stats["leaves"] - 1).all()
    assert (stats["nodes"] <= stats["nodes_grown"]).all()


def test_rules_name_every_leaf(fitted):
    rules = fitted.rules().toPandas()
    leaves = fitted.nodes.filter("is_leaf").count()
    assert len(rules) == leaves
    first = rules[rules.model_id == "a~x_in"].iloc[0]
    assert "≤" in first["condition"] or ">" in first["condition"]
    assert "lag1_in=" in " ".join(rules[rules.model_id == "a~x_in"]["equation"])
    assert "lag1_out=" in " ".join(rules[rules.model_id == "b~x_out"]["equation"])


def test_missing_numbers_and_unseen_channels(spark, fitted, data):
    num, _, _ = data["a~x_in"]
    row = num[0].copy()
    filled = row.copy()
    filled[2] = num[:, 2].mean()
    row = [None if i == 2 else float(v) for i, v in enumerate(row)]
    schema = "model_id string, num array<double>, channel string"
    frame = spark.createDataFrame(
        [("a~x_in", row, "NEW"), ("a~x_in", filled.tolist(), "OTHER")], schema
    )
    got = [r.prediction for r in fitted.predict(frame).collect()]
    assert got[0] == pytest.approx(got[1], rel=1e-12)


def test_row_order_and_partitions_do_not_matter(spark, fitted, data):
    rows = rows_frame(spark, data).orderBy(F.col("row_id").desc()).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = T.fit(rows, PARAMS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = ["model_id", "node_id"]
    a = fitted.nodes.select(*keys, "feature", "threshold", "n", "level").toPandas()
    b = again.nodes.select(*keys, "feature", "threshold", "n", "level").toPandas()
    pd.testing.assert_frame_equal(
        a.sort_values(keys).reset_index(drop=True), b.sort_values(keys).reset_index(drop=True),
        rtol=1e-8,
    )


def test_save_load_and_reuse(spark, fitted, data):
    uri = fresh_dir(spark, "models")
    assert not T.has_models(spark, uri)
    fitted.save(uri)
    assert T.has_models(spark, uri)
    rows = rows_frame(spark, data)
    a, b = predictions(fitted, rows), predictions(T.load(spark, uri), rows)
    for name in a:
        np.testing.assert_array_equal(a[name], b[name])


def test_of_two_publishers_one_wins(spark, fitted):
    import threading

    from cashtide.sources import commits

    uri, outcome = fresh_dir(spark, "models"), []

    def publish():
        try:
            fitted.save(uri)
            outcome.append("won")
        except commits.Conflict:
            outcome.append("lost")

    threads = [threading.Thread(target=publish) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome) == ["lost", "won"]
    assert T.load(spark, uri).nodes.count() == fitted.nodes.count()
    fitted.save(uri)
    assert commits.newest(spark, uri)[0] == 1


def test_scoring_uses_no_python(spark, fitted, data):
    plan = fitted.predict(rows_frame(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def _daily(spark, n=120):
    rng = np.random.default_rng(9)
    rows = [
        (s, datetime.date(2023, 1, 1) + datetime.timedelta(days=i), float(rng.integers(50, 150)),
         float(rng.integers(10, 90)), CHANNELS[i % 3])
        for s in ("A", "B")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "account string, date date, cash_in double, cash_out double, channel string"
    )


def test_all_targets_of_all_series_train_together(spark):
    features = X.training_set(_daily(spark), ("account",))
    early, late = T.holdout(features, datetime.date(2023, 4, 20))
    model = T.train(early, ("account",), params=PARAMS)
    assert {r.model_id for r in model.stats().collect()} == {
        f"{s}~{t}" for s in ("A", "B") for t in TARGETS
    }
    wide = model.predict_all(late, ("account",))
    assert wide.columns == ["account", "date", *TARGETS]
    assert wide.count() == late.count()
    long = model.predict(P.training_rows(late, ("account",))).toPandas()
    got = wide.toPandas().melt(["account", "date"], TARGETS, "target", "wide")
    got["model_id"] = got["account"] + "~" + got["target"]
    got["row_id"] = got["account"] + "~" + got["date"].astype(str)
    both = long.merge(got, on=["model_id", "row_id"])
    assert len(both) == len(long) > 0
    np.testing.assert_allclose(both["wide"], both["prediction"].clip(lower=0), rtol=1e-12)
    assert "Python" not in wide._jdf.queryExecution().executedPlan().toString()
    low = wide.select(F.least(*[F.min(t) for t in TARGETS])).first()[0]
    assert low >= 0
    report = T.metrics(model, early, ("account",)).toPandas()
    assert len(report) == 12 and (report["rmse"] > 0).all()
    assert T.metrics(model, late, ("account",)).count() >= 4


def test_ensure_trains_what_is_missing(spark):
    uri = fresh_dir(spark, "models")
    features = X.training_set(_daily(spark, 60), ("account",))
    wanted, small = ("cash_in_next_day", "cash_out_next_day"), replace(PARAMS, max_depth=2)
    first = T.ensure(features, uri, ("account",), wanted[:1], small)
    files = set(first.nodes.inputFiles())
    assert set(T.ensure(features, uri, ("account",), wanted[:1], small).nodes.inputFiles()) == files
    both = T.ensure(features, uri, ("account",), wanted, small)
    assert both.targets() == set(wanted)
    names = both.schema().filter("target_column = 'cash_out_next_day'").first()
    assert tuple(names["required_features"]) == FEATURES_OUT
    assert names["all_feature_names"][:3] == ["cash_in_d0", "cash_out_d0", "cash_net_d0"]
    wide = both.predict_all(features, ("account",), wanted)
    assert wide.filter(f"{wanted[0]} IS NULL OR {wanted[1]} IS NULL").count() == 0
    forced = T.ensure(features, uri, ("account",), wanted[:1], small, force=True)
    assert set(forced.nodes.inputFiles()).isdisjoint(files)
    # A save that broke off before publishing leaves the old version in place.
    first.nodes.write.parquet(f"{uri}/versions/broken/nodes")
    assert set(T.load(spark, uri).nodes.inputFiles()) == set(forced.nodes.inputFiles())


def test_a_loaded_tree_keeps_its_depth(spark, data):
    deep = T.fit(rows_frame(spark, data), replace(PARAMS, max_depth=12, prune=False))
    uri = fresh_dir(spark, "models")
    deep.save(uri)
    back = T.load(spark, uri)
    assert back.max_depth == 12
    scored = back.predict(rows_frame(spark, data))
    assert scored.filter("prediction IS NULL").count() == 0


def test_series_of_odd_names_stay_apart(spark):
    keys = [(None, "x"), ("x", None), ("a~b", "c"), ("a", "b~c"), ("a%7Eb", "c"), ("", "x")]
    frame = spark.createDataFrame(keys, "k string, l string").select(
        "k", "l", P.series_name(("k", "l")).alias("name")
    )
    assert frame.select("name").distinct().count() == len(keys)
    days = _daily(spark, 60).filter("account = 'A'")
    named = spark.createDataFrame(keys, "k string, l string")
    features = X.training_set(days.drop("account").crossJoin(named), ("k", "l"))
    target = ("cash_in_next_day",)
    model = T.train(features, ("k", "l"), target, replace(PARAMS, max_depth=1))
    assert model.models.count() == len(keys)
    wide = model.predict_all(features, ("k", "l"), target)
    assert wide.count() == features.count()
    assert wide.filter("cash_in_next_day IS NULL").count() == 0


def test_feature_columns_of_each_direction(spark):
    rows = P.training_rows(X.training_set(_daily(spark, 60), ("account",)), ("account",))
    names = P.feature_names(P.fit(rows), P.channels(rows)).filter("feature < 10").toPandas()
    one = names[names.model_id == "A~cash_in_h7_sum"].sort_values("feature")["name"]
    assert list(one) == list(FEATURES_IN[:-1])


def _located(spark, n, width=P.WIDTH):
    """Rows of one node with distinct numerics."""
    x = F.expr(f"transform(sequence(1, {width}), i -> double(hash(id, i)) / 1000)")
    rows = spark.range(n).select(
        F.expr("concat('m', id * 0)").alias("model_id"), F.expr("int(id * 0 + 1)").alias("node_id"),
        F.expr("double(hash(id, 0)) / 1e6").alias("y"), x.alias("x"),
    )
    return S.with_bands(rows)


def test_what_a_level_shuffles_does_not_grow_with_the_rows(spark):
    sizes = []
    for n in (20_000, 80_000):
        located = _located(spark, n)
        sums = S.band_sums(located)
        plan = sums._jdf.queryExecution().executedPlan().toString()
        first = plan[plan.index("Exchange hashpartitioning(") :].splitlines()[1]
        assert "HashAggregate" in first and "partial_sum" in first  # combined before it moves
        wanted = S.looked_into(sums, PARAMS)
        sizes.append((sums.count(), wanted.count()))
        values = S.value_sums(located, wanted).count()
        assert values < 0.3 * n * P.WIDTH
    assert max(s[0] for s in sizes) <= P.BANDS * P.WIDTH
    assert max(s[1] for s in sizes) <= 2 * PARAMS.percentiles * P.WIDTH


def test_limits_do_not_travel_with_the_rows(spark, data, monkeypatch):
    """What deals the rows carries no limits, and each share of a model meets them, whatever the join."""
    cut, written = T.cut, {}

    def spy(df, label):
        written[label] = df
        return cut(df, label)

    def inside(node):
        below = node.children()
        return [node] + [n for i in range(below.size()) for n in inside(below.apply(i))]

    def dealt(df):
        found = inside(df._jdf.queryExecution().optimizedPlan())
        dealers = [n for n in found if n.nodeName() == "RepartitionByExpression"]
        return [{n.output().apply(i).name() for i in range(n.output().size())} for n in dealers]

    monkeypatch.setattr(T, "cut", spy)
    rows = rows_frame(spark, data)
    prep, numbered, ready = T.prepared(rows)
    whole = sorted(map(tuple, ready.collect()))
    (held,) = dealt(written["prepared-rows"])
    assert "num" in held and not held & {"limits", "scales"}
    assert len(dealt(written["training-rows"])) == 1  # rows of one series do not stay in one file
    monkeypatch.setattr(P, "ROWS_TOGETHER", 30)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (threshold, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            shares = P.apply(rows, prep, numbered, "number").collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert sorted(map(tuple, shares)) == whole != []


def test_banded_splits_equal_brute_force(spark):
    located = _located(spark, 3000)
    rows = located.select("y", "x").toPandas()
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy()
    got = S.best(S.score(S.candidates(located, PARAMS), PARAMS)).first()
    _, feature, threshold, gain = B.find_split(x, y, PARAMS)
    assert (got["feature"], got["threshold"]) == (feature, pytest.approx(threshold, rel=1e-12))
    assert got["sdr"] == pytest.approx(gain, rel=1e-8)


def _gradients(num, channel, y, coef, effects, level, alpha):
    """What is left of the normal equations of a ridge model."""
    sd = num.std(axis=0)
    x = (num - num.mean(axis=0)) / np.where(sd == 0, 1, sd)
    names, index = np.unique(channel, return_inverse=True)
    hot = np.array([effects.get(n, 0.0) for n in names])
    miss = y - level - x @ coef - hot[index]
    by_channel = np.bincount(index, miss)
    return miss.sum(), x.T @ miss - alpha * coef, by_channel - alpha * hot


def test_ten_thousand_channels(spark):
    rng = np.random.default_rng(4)
    n, many = 30_000, 10_000
    num = np.round(rng.normal(size=(n, P.WIDTH)), 3)
    channel = np.array([f"c{i:05d}" for i in np.arange(n) % many])
    effect = rng.normal(scale=1e3, size=many)
    y = 1e4 + 300 * num[:, 0] + effect[np.arange(n) % many] + rng.normal(size=n)
    rows = rows_frame(spark, {"m~x_in": (num, channel, y)})
    model = T.fit(rows, replace(PARAMS, max_depth=1))
    assert model.names.count() == P.WIDTH + many
    assert model.lookup.count() == many
    assert model.nodes.select(F.max(F.size("coef"))).first()[0] == P.WIDTH
    for table in (model.nodes, model.models, model.effects, model.lookup):
        lists = [f.name for f in table.schema if f.dataType.typeName() == "array"]
        widest = [table.select(F.max(F.size(c))).first()[0] or 0 for c in lists]
        assert max(widest, default=0) <= P.BANDS
    whole = T.fit(rows, replace(PARAMS, max_depth=0))
    root = whole.nodes.first()
    assert root["used"] == P.WIDTH + many
    names = {r["feature"] - P.WIDTH: r["name"][8:] for r in whole.names.filter(f"feature >= {P.WIDTH}").collect()}
    hot = {names[r["c"]]: r["coef"] for r in whole.effects.collect()}
    parts = _gradients(num, channel, y, np.array(root["coef"]), hot, root["level"], PARAMS.ridge_alpha)
    assert max(np.abs(p).max() for p in parts) < 1e-3
    got = whole.predict(rows, smooth=False).select("row_id", "channel", "prediction").toPandas()
    x = (num - num.mean(axis=0)) / num.std(axis=0)
    expected = root["level"] + x @ np.array(root["coef"]) + np.array([hot[c] for c in channel])
    np.testing.assert_allclose(got.sort_values("row_id")["prediction"], expected, rtol=1e-9)


def test_ten_thousand_small_models(spark):
    """No Python runs by model or node; each model equals plain ridge regression."""
    from cashtide.modeltree import ridge

    many, each = 10_000, 40
    x = F.expr(f"transform(sequence(1, {P.WIDTH}), i -> double(hash(id, i) % 1000) / 250)")
    rows = spark.range(many * each).select(
        (F.col("id") % many).alias("model_id"), x.alias("x"),
        F.expr("double(hash(id, 0) % 1000)").alias("y"), F.expr("int(pmod(hash(id, 99), 3))").alias("c"),
        F.expr("array_repeat(0, 10)").alias("b"),
    ).repartition("model_id")
    models, effects = ridge.node_models(rows, None, PARAMS)
    text = models._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text and "MapInPandas" not in text
    assert models.count() == many
    sample = list(range(0, many, 997))
    held = rows.filter(F.col("model_id").isin(sample)).toPandas()
    found = models.filter(F.col("model_id").isin(sample)).toPandas().set_index("model_id")
    hot = effects.filter(F.col("model_id").isin(sample)).toPandas()
    for number in sample:
        own = held[held.model_id == number]
        wide = np.hstack([np.array(own["x"].tolist()), np.eye(3)[own["c"].to_numpy()]])
        coef, level, used = B.ridge(wide, own["y"].to_numpy(), PARAMS.ridge_alpha)
        mine = found.loc[number]
        np.testing.assert_allclose(mine["coef"], coef[: P.WIDTH], rtol=1e-6, atol=1e-6)
        assert mine["intercept"] == pytest.approx(level, rel=1e-6, abs=1e-6)
        assert mine["used"] == len(used)
        channels = hot[hot.model_id == number].sort_values("c")
        np.testing.assert_allclose(channels["coef"], coef[P.WIDTH :], rtol=1e-5, atol=1e-6)
        miss = own["y"].to_numpy() - wide @ coef - level
        assert mine["sse"] == pytest.approx((miss**2).sum(), rel=1e-6)


def test_rows_of_an_unknown_series_are_kept(spark, fitted, data):
    known = rows_frame(spark, data)
    unknown = known.limit(3).withColumn("model_id", F.lit("new~x_in"))
    scored = fitted.predict(known.unionByName(unknown))
    assert scored.count() == known.count() + 3
    lost = scored.filter("model_id = 'new~x_in'")
    assert lost.filter("prediction IS NULL AND node_id IS NULL").count() == 3
    assert scored.filter("prediction IS NULL").count() == 3
    features = X.training_set(_daily(spark, 60), ("account",))
    model = T.train(features.filter("account = 'A'"), ("account",), params=replace(PARAMS, max_depth=2))
    wide = model.predict_all(features, ("account",))
    assert wide.count() == features.count()
    nothing = " AND ".join(f"{t} IS NULL" for t in TARGETS)
    assert wide.filter("account = 'B'").count() == wide.filter(nothing).count() > 0
