"""Ingest, de-duplication and ledger behaviour on hand-made payloads."""

import datetime

import pytest
from pyspark.sql import functions as F

from cashtide.functions import jsonmap
from cashtide.operators import daily, dedup, ingest, ledger
from cashtide.schemas import PAYLOAD
from cashtide.session import fresh_dir
from cashtide.sources import files

T0 = datetime.datetime(2024, 1, 15, 10, 0, 0)


def plain(held):
    """A map of variants as a dict."""
    return {k: v.toPython() for k, v in held.items()}


def payload(spark, *rows):
    names = PAYLOAD.fieldNames()
    base = {"event_ts": T0, "currency": "VND", "amount": 0.0}
    full = []
    for number, row in enumerate(rows):
        filled = {**base, "tx_id": f"t{number:03d}", **row}
        full.append(tuple(filled.get(name) for name in names))
    return spark.createDataFrame(full, PAYLOAD)


def test_account_type_and_id_defaults(spark):
    rows = payload(
        spark,
        {"sender_id": "A", "amount": 5.0},
        {"receiver_id": "B", "amount": 5.0, "client_transfer_id": "X"},
        {"account_id": "C", "sender_id": "D", "type": "p2p", "currency": None},
        {"amount": 1.0},
    )
    got = ingest.normalize_payload(rows).orderBy("tx_id").collect()
    assert [r.account_id for r in got] == ["A", "B", "C", None]
    assert [r.transaction_type for r in got] == ["cash_out", "cash_in", "p2p", None]
    assert got[1].client_tx_id == "X" and len(got[0].client_tx_id) == 36
    assert got[2].currency == "VND"
    assert plain(got[2].extra) == {"sender_id": "D", "form_type": "p2p"}
    assert got[3].extra is None


def test_transfer_gives_two_linked_legs(spark):
    rows = payload(
        spark, {"sender_id": "A", "receiver_id": "B", "amount": 7.0, "extra_json": '{"z":"1"}'}
    )
    legs = ingest.split_transfers(ingest.normalize_payload(rows))
    sender, receiver = sorted(legs.collect(), key=lambda r: r.account_id)
    assert plain(sender.extra) == {
        "p2p_role": "sender", "z": "1", "counterparty_account_id": "B", "sender_id": "A",
        "receiver_id": "B",
    }
    assert receiver.account_id == "B" and receiver.transaction_type == "cash_in"
    assert plain(receiver.extra)["mirror_of"] == sender.tx_id
    assert receiver.client_tx_id != sender.client_tx_id
    pair = ledger.paired_transfers(legs).collect()
    assert [(p.from_account, p.to_account, p.status) for p in pair] == [("A", "B", "PENDING")]


def test_stored_row_decodes_to_the_same_names(spark):
    rows = payload(
        spark,
        {"account_id": "A", "client_tx_id": "c1", "transaction_type": " Deposit ", "amount": 1.1,
         "extra_json": '{"direction":"keep"}', "description": "d"},
    )
    stored, refused = ingest.ingest(rows)
    assert str(stored.first().amount) == "1.1000000000" and refused.count() == 0
    back = ingest.decode_ledger(stored).first()
    assert (back.client_tx_id, back.transaction_type, back.direction) == ("c1", "cash_in", "keep")
    assert (back.description, back.type, back.amount) == ("d", "cash_in", 1.1)


def test_reject_reasons(spark):
    rows = payload(
        spark,
        {"account_id": "A", "amount": 1.0},
        {"amount": 1.0},
        {"account_id": "A", "amount": 1.0, "event_ts": None},
        {"account_id": "A", "amount": 1.0, "currency": "ABC"},
        {"account_id": "A", "amount": 0.0},
    )
    classified = ingest.classify(ingest.normalize_payload(rows)).orderBy("tx_id")
    assert [r.reject_reason for r in classified.collect()] == [
        None, "missing_account", "missing_date", "unsupported_currency", "zero_amount",
    ]
    assert ingest.accepted(classified).count() == 1
    assert ingest.rejected(classified).count() == 4


def _sent_thirty(spark):
    """20 distinct client ids, the first ten sent again later with another type."""
    first = [
        {"account_id": "ACC", "client_tx_id": f"TX-{i:04d}", "amount": 100000.0,
         "transaction_type": "deposit"}
        for i in range(20)
    ]
    again = [
        {**row, "transaction_type": "cash_in", "event_ts": T0 + datetime.timedelta(minutes=1)}
        for row in first[:10]
    ]
    return payload(spark, *first, *again)


def test_repeats_are_refused_and_reported(spark):
    rows = _sent_thirty(spark)
    kept = dedup.first_wins(rows)
    assert kept.count() == 20
    assert {r.transaction_type for r in kept.collect()} == {"deposit"}
    report = dedup.duplicates_report(rows).collect()
    assert len(report) == 10 and {r.status for r in report} == {"duplicate"}
    assert all(int(r.tx_id[1:]) - int(r.first_tx_id[1:]) == 20 for r in report)
    assert tuple(dedup.evidence(rows).first()) == (30, 20)


def test_rows_without_client_id_are_never_repeats(spark):
    rows = payload(spark, *[{"account_id": "A", "client_tx_id": c} for c in (None, "", None)])
    assert dedup.first_wins(rows).count() == 3
    assert dedup.duplicates_report(rows).count() == 0


def test_history_keys_are_excluded(spark):
    rows = payload(spark, {"account_id": "A", "client_tx_id": "1"},
                   {"account_id": "A", "client_tx_id": "2"}, {"account_id": "B"})
    seen = spark.createDataFrame([("A", "1")], "account_id string, client_tx_id string")
    left = dedup.unseen(rows, seen).collect()
    assert sorted((r.account_id, r.client_tx_id or "") for r in left) == [("A", "2"), ("B", "")]


@pytest.mark.parametrize("max_hot", [1, 3, 10_000])
def test_hot_keys_give_the_same_report(spark, max_hot):
    """One key holds most rows; wherever the hot line falls, the report is complete."""
    copies = {"hot": 400, "warm": 30, "cold": 2, "single": 1}
    rows = payload(
        spark,
        *[{"account_id": "A", "client_tx_id": key} for key, n in copies.items() for _ in range(n)],
    )
    report = dedup.duplicates_report(rows, max_hot).collect()
    assert len(report) == 399 + 29 + 1
    assert len({r.tx_id for r in report}) == len(report)
    assert {(r.client_tx_id, r.first_tx_id) for r in report} == {
        ("hot", "t000"), ("warm", "t400"), ("cold", "t430"),
    }


def test_amount_without_type_counts_by_sign(spark):
    rows = payload(
        spark,
        {"account_id": "A", "amount": -123000.0, "merchant": "POS"},
        {"account_id": "A", "amount": 5000000.0, "transaction_type": "in"},
        {"account_id": "A", "amount": 3000000.0, "transaction_type": "deposit"},
        {"account_id": "A", "amount": 1877000.0, "transaction_type": "out"},
    )
    cash = ingest.split_in_out(ingest.accepted(ingest.classify(ingest.normalize_payload(rows))))
    day = daily.roll_up(cash).first()
    assert (int(day.cash_in), int(day.cash_out), day.transaction_count) == (8000000, 2000000, 4)
    assert (day.day_of_week, day.month, day.quarter, int(day.balance)) == (0, 1, 1, 6000000)


def test_required_columns(spark):
    ready = spark.createDataFrame([(1,)], "date int").selectExpr("date", "1 cash_in", "2 cash_out")
    assert ingest.require_cash_columns(ready) is ready
    raw = spark.createDataFrame(
        [(-4.0, "deposit", "2024-01-02"), (6.0, None, "2024-01-03"), (6.0, "in", None)],
        "amount double, transaction_type string, date string",
    )
    rows = ingest.require_cash_columns(raw).orderBy("date").collect()
    assert [(int(r.cash_in), int(r.cash_out)) for r in rows] == [(4, 0), (6, 0)]
    with pytest.raises(ValueError, match="cash_out"):
        ingest.require_cash_columns(raw.drop("amount").withColumn("cash_in", F.lit(1)))


def test_balances_and_statements(spark):
    day = datetime.timedelta(days=1)
    rows = payload(
        spark,
        {"account_id": "A", "amount": 10.0, "transaction_type": "in"},
        {"account_id": "A", "amount": 4.0, "transaction_type": "out", "event_ts": T0 + day},
        {"account_id": "A", "amount": 1.0, "transaction_type": "in", "event_ts": T0 + 20 * day},
    )
    cash = ingest.accepted(ingest.classify(ingest.normalize_payload(rows)))
    assert float(ledger.account_balances(cash).first().balance) == 7.0
    st = ledger.daily_statements(cash).orderBy("day").collect()
    assert [(float(r.balance_open), float(r.balance_close)) for r in st] == [
        (0, 10), (10, 6), (6, 7),
    ]
    months = ledger.month_summary(cash).orderBy("month").collect()
    assert [(float(m.total_in), float(m.total_out), float(m.balance)) for m in months] == [
        (10, 4, 6), (1, 0, 7),
    ]


def test_ledger_table_is_pruned_by_day_and_account(spark):
    uri = fresh_dir(spark, "ledger")
    rows = payload(
        spark,
        *[
            {"account_id": f"A{i % 3}", "amount": 1.0,
             "event_ts": T0 + datetime.timedelta(days=i % 4, minutes=i)}
            for i in range(24)
        ],
    )
    files.append_ledger(ingest.ingest(rows)[0], uri)
    table = files.read_ledger(spark, uri)
    hits = ledger.account_day(table, "A1", T0.date(), limit=2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "EqualTo(account_id,A1)" in plan
    got = [r.event_ts for r in hits.collect()]
    assert len(got) == 2 and got == sorted(got, reverse=True)


def test_limits_are_the_callers(spark):
    rows, _ = ingest.ingest(payload(spark, *[{"account_id": "A", "amount": 1.0}] * 120))
    assert ledger.account_day(rows, "A", T0.date(), 110).count() == 110
    assert ledger.account_range(rows, "A", T0.date(), T0.date(), 119).count() == 119
    assert ledger.most_recent(rows, 6000).count() == 120


def test_rows_without_ids_are_all_kept(spark):
    rows = payload(
        spark, *[{"account_id": "A", "tx_id": None, "amount": 3.0}] * 5,
        {"sender_id": "A", "receiver_id": "B", "tx_id": None, "amount": 4.0},
    )
    stored, refused = ingest.ingest(rows)
    got = stored.collect()
    assert len(got) == 7 and refused.count() == 0
    assert len({r.tx_id for r in got}) == 7 and None not in {r.tx_id for r in got}
    with pytest.raises(Exception, match="draw_ids"):
        dedup.first_wins(ingest.normalize_payload(rows)).collect()


def test_client_ids_count_per_sender_whichever_field_brings_them(spark):
    def sent(**row):
        return {"amount": 1.0, "tx_id": None, **row}

    rows = payload(
        spark,
        sent(sender_id="A", client_tx_id="X"),
        sent(sender_id="B", client_tx_id="X"),
        sent(account_id="C", client_transfer_id="T"),
        sent(account_id="C", client_transfer_id="T"),
        sent(account_id="C", client_transfer_id="T", event_ts=T0 + datetime.timedelta(days=1)),
        sent(sender_id="D", receiver_id="E", client_tx_id="P"),
        sent(sender_id="D", receiver_id="E", client_tx_id="P"),
    )
    got = ingest.ingest(rows)[0].collect()
    assert sorted(r.account_id for r in got) == ["A", "B", "C", "D", "E"]
    again = ingest.ingest(rows)[0].collect()
    assert {r.tx_id for r in got} == {r.tx_id for r in again}


def test_money_is_converted_before_it_is_rounded(spark):
    rows = payload(
        spark,
        {"account_id": "A", "amount": 1.999, "currency": "EUR"},
        {"account_id": "A", "amount": 0.004, "currency": "USD"},
        {"account_id": "A", "amount": 1e19},
    )
    stored, refused = ingest.ingest(rows)
    vnd = ingest.accepted(ingest.cash_legs(rows)).orderBy("tx_id").collect()
    assert [float(r.amount_vnd) for r in vnd] == [51574.20, 94.60]
    assert sorted(float(r.amount) for r in stored.collect()) == [0.004, 1.999]
    assert [r.reject_reason for r in refused.collect()] == ["amount_out_of_range"]


def test_refused_rows_are_kept_with_their_reason(spark):
    rows = payload(spark, {"amount": 1.0}, {"account_id": "A", "amount": 1.0, "event_ts": None})
    stored, refused = ingest.ingest(rows)
    assert stored.count() == 0
    uri = fresh_dir(spark, "rejects")
    files.append_rejects(refused, uri)
    back = spark.read.parquet(uri).orderBy("tx_id").collect()
    assert [r.reject_reason for r in back] == ["missing_account", "missing_date"]


def test_text_that_is_no_object_and_columns_reach_the_ledger(spark):
    rows = payload(
        spark, {"account_id": "A", "amount": 1.0, "extra_json": "just text"}
    ).withColumns(
        {"transfer_id": F.lit("TR"), "counterparty_account_id": F.lit("Z"), "direction": F.lit("OUT")}
    )
    row = ingest.ingest(rows)[0].select("*", jsonmap.decode("extra_json").alias("m")).first()
    held = plain(row.m)
    assert held["raw_extra"] == "just text" and held["transfer_id"] == "TR"
    assert held["counterparty_account_id"] == "Z" and held["direction"] == "out"
    assert (row.transfer_id, row.counterparty_account_id, row.direction) == ("TR", "Z", "OUT")


def test_bad_payload_lines_are_rejected_not_lost(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"account_id":"A","amount":1.5}\n{broken\n')
    rows = files.read_payloads(spark, str(tmp_path))
    classified = ingest.classify(ingest.normalize_payload(rows)).collect()
    assert {(r.reject_reason, r.raw_line) for r in classified} == {
        ("missing_date", None), ("unreadable_line", "{broken"),
    }
    (tmp_path / "q.json").write_text('{"account_id":"A","amount":"much"}\n\n[1,2\n')
    lines = files.read_payloads(spark, str(tmp_path / "q.json"))
    refused = ingest.ingest(lines)[1]
    assert {(r.reject_reason, r.raw_line) for r in refused.collect()} == {
        ("unreadable_line", '{"account_id":"A","amount":"much"}'), ("unreadable_line", "[1,2"),
    }


def test_lookup_by_id_skips_row_groups(spark):
    """Of many days the scan reads the row groups whose bloom filter holds the id."""
    from cashtide.schemas import LEDGER

    days, each = 40, 500
    kinds = {f.name: f.dataType.simpleString() for f in LEDGER}
    made = {
        "account_id": "concat('A', id % 50)", "event_date": f"date_add(date'2024-01-01', int(id / {each}))",
        "event_ts": f"timestamp_seconds(1704067200 + int(id / {each}) * 86400 + id % {each})",
        "tx_id": "concat('tx-', hash(id), '-', id)", "amount": "cast(id AS decimal(28,10))",
    }
    rows = spark.range(days * each).selectExpr(
        *[f"cast({made.get(n, 'null')} AS {k}) AS {n}" for n, k in kinds.items()], "id"
    )
    uri = fresh_dir(spark, "indexed-ledger")
    files.append_ledger(rows.select(*kinds), uri)
    wanted = rows.filter("id = 7777").first()["tx_id"]
    found = ledger.by_tx_id(files.read_ledger(spark, uri), wanted)
    assert [r.tx_id for r in found.collect()] == [wanted]
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
        while plan.children().size():
            plan = plan.children().head()
    read = plan.metrics().apply("numOutputRows").value()
    assert 0 < read <= 3 * each  # of 20,000 rows; a filter may be wrong now and then


def test_an_id_given_twice_returns_the_newest(spark):
    frame = spark.createDataFrame(
        [("A", datetime.datetime(2024, 1, d), "x") for d in (1, 3, 2)], "account_id string, event_ts timestamp, tx_id string"
    )
    assert ledger.by_tx_id(frame, "x").first()["event_ts"].day == 3


def test_extra_defaults_do_not_overwrite(spark):
    df = spark.createDataFrame([('{"client_tx_id":"old"}',)], "x string")
    kept = jsonmap.set_default(
        jsonmap.decode("x"), jsonmap.additions(client_tx_id=F.lit("new"), direction=F.lit("in"))
    )
    assert plain(df.select(kept).first()[0]) == {"direction": "in", "client_tx_id": "old"}
