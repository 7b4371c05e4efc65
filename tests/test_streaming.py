"""Streams over several files and several runs give the batch results."""

import datetime

from pyspark.sql import functions as F

from cashtide.operators import daily as D
from cashtide.operators import dedup, ingest, kpi, ledger
from cashtide.schemas import DEDUP_KEYS, PAYLOAD
from cashtide.session import fresh_dir
from cashtide.sources import files, tables
from cashtide.streaming import jobs

PARTS = 3


def payload_files(spark, sf, parts=PARTS):
    """The events as payload JSON, one file per part; returns the folder and the rows."""
    uri = fresh_dir(spark, "payload-files")
    rows = tables.payloads(spark, sf).select(*PAYLOAD.fieldNames())
    rows.repartition(parts, "tx_id").write.json(uri)
    return uri, files.read_payloads(spark, uri)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def ingested(spark, source):
    """The folder of a ledger written by a stream over the payload files of ``source``."""
    uri, state = fresh_dir(spark, "ledger"), fresh_dir(spark, "state")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest_batches(jobs.payload_stream(spark, source, files_per_trigger=1), uri, state)
    return uri


def test_ingest_of_one_batch_is_the_batch_ingest(spark, sf):
    source, rows = payload_files(spark, sf, parts=1)
    uri = ingested(spark, source)
    columns = ("account_id", "event_date", "event_ts", "tx_id", "amount", "extra_json")
    got = files.read_ledger(spark, f"{uri}/ledger")
    expected, refused = ingest.ingest(rows)
    assert got.count() == expected.count()
    assert as_set(got, *columns) == as_set(expected, *columns)
    reasons = ("account_id", "tx_id", "reject_reason")
    assert as_set(spark.read.parquet(f"{uri}/rejects"), *reasons) == as_set(refused, *reasons)


def test_ingest_remembers_keys_across_batches(spark, sf):
    source, rows = payload_files(spark, sf)
    uri = ingested(spark, source)
    keys = spark.read.schema(DEDUP_KEYS).parquet(f"{uri}/keys")
    expected = as_set(dedup.first_wins(rows), *dedup.KEYS)
    assert keys.count() == len(expected)
    assert as_set(keys, *dedup.KEYS) == expected
    legs = files.read_ledger(spark, f"{uri}/ledger").select("tx_id")
    assert legs.count() == legs.distinct().count()


def totals_match(spark, uri):
    ledger_rows = ingest.classify(ingest.decode_ledger(files.read_ledger(spark, f"{uri}/ledger")))
    return ledger_rows.cache()


def test_totals_across_batches(spark, sf):
    source, _ = payload_files(spark, sf)
    uri = ingested(spark, source)
    rows = totals_match(spark, uri)
    out, state = fresh_dir(spark, "daily"), fresh_dir(spark, "state")
    stream = jobs.ledger_stream(spark, uri, files_per_trigger=25)
    jobs.append_versions(jobs.daily_totals(stream, ("channel",)), out, state, ["channel", "date"])
    columns = ("channel", "date", "cash_in", "cash_out", "transaction_count")
    got = jobs.newest_versions(spark, out, ["channel", "date"])
    assert as_set(got, *columns) == as_set(D.roll_up(ingest.split_in_out(rows), ("channel",)), *columns)
    held = as_set(got, *columns)
    jobs.compact(spark, out, ["channel", "date"])
    jobs.vacuum(spark, out)
    again = jobs.newest_versions(spark, out, ["channel", "date"])
    assert as_set(again, *columns) == held

    out, state = fresh_dir(spark, "balances"), fresh_dir(spark, "state")
    stream = jobs.ledger_stream(spark, uri, files_per_trigger=25)
    jobs.append_versions(jobs.account_totals(stream), out, state)
    got = jobs.newest_versions(spark, out, ["account_id"])
    columns = ("account_id", "balance", "updated_at")
    assert as_set(got, *columns) == as_set(ledger.account_balances(rows), *columns)
    rows.unpersist()


def send(spark, uri, account, day, amount, tx):
    names = PAYLOAD.fieldNames()
    row = {"account_id": account, "client_tx_id": tx, "tx_id": tx, "amount": amount,
           "transaction_type": "in", "event_ts": datetime.datetime(2024, 1, day)}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], PAYLOAD)
    df.coalesce(1).write.mode("append").json(uri)


def test_late_rows_for_an_old_day_are_added(spark):
    source, uri, out = (fresh_dir(spark, n) for n in ("in", "ledger", "daily"))
    states = [fresh_dir(spark, "state") for _ in range(2)]
    for day, amount, tx in ((1, 5.0, "a"), (28, 7.0, "b"), (1, 6.0, "c"), (1, 9.0, "c")):
        send(spark, source, "A", day, amount, tx)
        jobs.ingest_batches(jobs.payload_stream(spark, source), uri, states[0])
        jobs.append_versions(jobs.daily_totals(jobs.ledger_stream(spark, uri)), out, states[1])
    rows = jobs.newest_versions(spark, out, ["date"]).collect()
    got = {r.date.day: float(r.cash_in) for r in rows}
    assert got == {1: 11.0, 28: 7.0}


def test_a_new_checkpoint_overwrites_nothing(spark):
    out = fresh_dir(spark, "balances")
    for account in ("A", "B"):
        source, uri = fresh_dir(spark, "in"), fresh_dir(spark, "ledger")
        send(spark, source, account, 1, 5.0, "x")
        jobs.ingest_batches(jobs.payload_stream(spark, source), uri, fresh_dir(spark, "state"))
        stream = jobs.account_totals(jobs.ledger_stream(spark, uri))
        jobs.append_versions(stream, out, fresh_dir(spark, "state"))
    got = jobs.newest_versions(spark, out, ["account_id"])
    assert {r.account_id for r in got.collect()} == {"A", "B"}


def test_a_stream_without_input_gives_an_empty_table(spark):
    schema = "account_id string, balance decimal(38,2), updated_at timestamp"
    out = fresh_dir(spark, "balances")
    assert jobs.newest_versions(spark, out, ["account_id"], schema).count() == 0


def test_bounded_dedup(spark, sf):
    source, rows = payload_files(spark, sf)
    keys = as_set(dedup.first_wins(rows), *dedup.KEYS)
    out, state = fresh_dir(spark, "keys"), fresh_dir(spark, "state")
    stream = jobs.dedup(jobs.payload_stream(spark, source, files_per_trigger=1), "40 days")
    kept = stream.select(*dedup.KEYS, F.to_date("event_ts").alias("day"))
    jobs.append(kept, out, state, "day")
    got = spark.read.parquet(out)
    assert got.count() == len(keys) and as_set(got, *dedup.KEYS) == keys


def test_kpi_stream_keeps_the_newest_write(spark, sf):
    first = kpi.daily_kpis(tables.daily(spark, sf))
    later = first.withColumns(
        {
            "value": F.col("value") + 1,
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 HOUR"),
        }
    )
    uri, out, state = (fresh_dir(spark, n) for n in ("kpi-in", "kpi", "state"))
    later.coalesce(1).write.parquet(uri)  # the newer write arrives first
    first.coalesce(1).write.mode("append").parquet(uri)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(uri)
    jobs.append_versions(jobs.kpi_totals(stream), out, state)
    got = jobs.newest_versions(spark, out, ["event_date", "metric"])
    columns = ("event_date", "metric", "value", "updated_at")
    assert as_set(got, *columns) == as_set(kpi.upsert(first, later), *columns)


def test_api_log_stream(spark, sf):
    calls = tables.api_calls(spark, sf)
    uri, out, state = (fresh_dir(spark, n) for n in ("calls-in", "calls", "state"))
    calls.repartition(2).write.parquet(uri)
    stream = spark.readStream.schema(calls.schema).parquet(uri)
    jobs.append_api_calls(stream, out, state)
    back = files.read_api_calls(spark, out)
    assert back.count() == calls.count()
    assert back.filter("day <> to_date(ts) OR status NOT IN (200, 500)").count() == 0


def test_a_batch_reads_no_more_for_all_keys_before_it(spark):
    """Fifty batches of new keys and one old one: what a batch looks up does not grow."""
    batches, each = 50, 40
    source, uri, state = (fresh_dir(spark, n) for n in ("in", "ledger", "state"))
    names = PAYLOAD.fieldNames()
    rows = []
    for b in range(batches):
        keys = [f"k{b}-{i}" for i in range(each)] + [f"k{max(b - 1, 0)}-0"]
        for key in keys:
            row = {"account_id": "A", "client_tx_id": key, "tx_id": f"{key}@{b}", "amount": 1.0,
                   "transaction_type": "in", "event_ts": datetime.datetime(2024, 1, 1 + b % 28)}
            rows.append((b, *[row.get(n) for n in names]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAYLOAD)
    frame = spark.createDataFrame(rows, f"b int, {kinds}").repartitionByRange(batches, "b")
    frame.drop("b").write.json(source)
    run = jobs.ingest_batches(jobs.payload_stream(spark, source, files_per_trigger=1), uri, state)
    keys = spark.read.schema(DEDUP_KEYS).parquet(f"{uri}/keys")
    assert keys.count() == keys.select(*dedup.KEYS).distinct().count() == batches * each
    assert files.read_ledger(spark, f"{uri}/ledger").count() == batches * each
    parts = jobs._parts(spark, f"{uri}/keys", "batch", lambda n: True)
    assert len(parts) >= batches - 2
    looked = [
        p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesRead"]
        for p in run.recentProgress if p["numInputRows"]
    ]
    assert len(looked) >= batches - 2
    late, early = max(looked[-5:]), max(looked[3:8])
    assert late <= 1.5 * early + 1000
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["numInputRows"]]
    assert totals[-1] > 5 * totals[3]  # while what is remembered does


def test_merging_under_a_running_stream(spark, monkeypatch):
    """A merge between two batches, and one that a batch overtakes, lose and repeat nothing."""
    source, uri, out, state = (fresh_dir(spark, n) for n in ("in", "ledger", "daily", "state"))
    ingest_state = fresh_dir(spark, "state")
    expected = {}
    for n in range(jobs.MOST_LIVE + 3):
        day = 1 + n % 3
        send(spark, source, "A", day, 1.0 + n, f"t{n}")
        expected[day] = expected.get(day, 0) + 1.0 + n
        jobs.ingest_batches(jobs.payload_stream(spark, source), uri, ingest_state)
        stream = jobs.daily_totals(jobs.ledger_stream(spark, uri))
        if n == 2:
            jobs.compact(spark, out, ["date"])
        if n == 4:  # the stream commits while a merge is being written
            real = jobs._store_version

            def slow(rows, folder, real=real, stream=stream):
                path = real(rows, folder)
                monkeypatch.setattr(jobs, "_store_version", real)
                jobs.append_versions(stream, out, state, ["date"])
                return path

            monkeypatch.setattr(jobs, "_store_version", slow)
            jobs.compact(spark, out, ["date"])
        else:
            jobs.append_versions(stream, out, state, ["date"])
        held = jobs._live(jobs.commits.newest(spark, out)[1])
        assert len(held) <= jobs.MOST_LIVE
        rows = jobs.newest_versions(spark, out, ["date"]).collect()
        assert {r.date.day: float(r.cash_in) for r in rows} == expected
    jobs.vacuum(spark, out)
    again = jobs.newest_versions(spark, out, ["date"]).collect()
    assert {r.date.day: float(r.cash_in) for r in again} == expected


def test_of_two_writers_one_commits(spark):
    import threading

    from cashtide.sources import commits

    uri, outcome = fresh_dir(spark, "commits"), []
    assert commits.newest(spark, uri) == (-1, None)
    commits.commit(spark, uri, 0, {"by": "first"})
    ready = threading.Barrier(2)

    def write(name):
        number, _ = commits.newest(spark, uri)
        ready.wait()
        try:
            commits.commit(spark, uri, number + 1, {"by": name})
            outcome.append(name)
        except commits.Conflict:
            outcome.append("conflict")

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome) in (["a", "conflict"], ["b", "conflict"])
    winner = next(o for o in outcome if o != "conflict")
    assert commits.newest(spark, uri) == (1, {"by": winner})
    total = commits.update(spark, uri, lambda old: {**old, "n": old.get("n", 0) + 1})
    assert total["n"] == 1 and commits.newest(spark, uri)[0] == 2
