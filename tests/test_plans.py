"""Physical plans keep the properties the library relies on at scale."""

import pytest

from cashtide.operators import dedup, ledger
from cashtide.plans import catalog
from cashtide.session import work_root
from cashtide.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_trims_before_the_shuffle(spark, sf):
    text = plan(dedup.first_wins(tables.payloads(spark, sf)))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_topk_trims_before_the_shuffle(spark, sf):
    text = plan(ledger.newest_per_account(tables.payloads(spark, sf), 3))
    assert text.count("WindowGroupLimit") == 2


def test_balances_read_only_needed_columns(spark, sf):
    text = plan(ledger.account_balances(tables.accepted_rows(spark, sf)))
    schema = text[text.rindex("ReadSchema") :]
    assert "event_id" not in schema
    assert "map_concat" not in text


@pytest.mark.parametrize(
    "name",
    [
        "account_balances", "balance_daily_snapshots", "company_stats", "daily_features",
        "dedup_duplicates_report", "kpi_monthly_by_account", "latency_p95", "p2p_pairing",
        "report_totals", "topk_per_account", "training_set",
    ],
)
def test_no_cross_join_and_no_python(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_work_folder_comes_from_the_session(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

    session = Session()
    session.conf = Conf("hdfs://nn/shared/")
    assert work_root(session) == "hdfs://nn/shared"
    session.conf = Conf(None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_root(session)
    assert work_root(spark) == work_root(spark)


def test_retrained_trees_are_those_of_plain_training(spark, sf):
    """Both retraining queries grow to the default depth; their trees are compared."""
    from cashtide.modeltree.params import TreeParams
    from cashtide.plans import tree_queries as Q

    def nodes(models):
        return sorted(map(tuple, models.stats().collect()))

    plain = Q.T.train(Q.training(spark, sf, seasonal=True))
    for models in (Q.csv_models(spark, sf), Q.daily_models(spark, sf)):
        assert models.max_depth == TreeParams().max_depth
        assert nodes(models) == nodes(plain) != []
