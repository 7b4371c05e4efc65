"""From request payloads to ledger rows: defaulting, transfer split, validity, decoding."""

from pyspark.sql import functions as F

from cashtide import session
from cashtide.functions import jsonmap
from cashtide.functions.clean import (
    blank_to_null,
    channel_or_default,
    first_filled,
    to_amount,
    to_number,
)
from cashtide.functions.dates import event_date
from cashtide.functions.ids import drawn_id, hash_id
from cashtide.functions.labels import infer_direction, normalize_type
from cashtide.functions.money import amount_vnd, vnd_rate
from cashtide.operators.dedup import first_wins
from cashtide.schemas import DEFAULT_CURRENCY, LEDGER


def draw_ids(payload):
    """Payloads with a ``tx_id`` for rows that bring no id of any kind.

    Such rows are never repeats of each other. Their ids are random, so these rows are
    written and read back before anything is derived from them.
    """
    named = [blank_to_null(c) for c in ("tx_id", "client_tx_id", "client_transfer_id")]
    has_id = F.coalesce(*named).isNotNull()
    without = payload.filter(~has_id).withColumn("tx_id", drawn_id())
    if payload.isStreaming:
        return payload.withColumn("tx_id", F.when(has_id, F.col("tx_id")).otherwise(drawn_id()))
    return payload.filter(has_id).unionByName(session.cut(without, "drawn-ids"))


def normalize_payload(payload):
    """Fill account, ids, type and currency, and copy the form fields into ``extra``.

    ``extra_json`` text becomes the map column ``extra``; the one label that decides the
    direction is read into ``inner_label``, so that roll-ups never build the map. Rows without any account stay
    in, with a null ``account_id``, for ``reject_reason`` to name.

    A missing ``tx_id`` is derived from account and client id, so a repeat derives the same;
    a missing client id from ``tx_id``. Rows with neither need ``draw_ids`` first.
    """
    account = blank_to_null("account_id")
    sender, receiver = blank_to_null("sender_id"), blank_to_null("receiver_id")
    role = F.when(
        account.isNull(),
        F.when(sender.isNotNull(), "cash_out").when(receiver.isNotNull(), "cash_in"),
    )
    form = jsonmap.additions(
        sender_id="sender_id",
        receiver_id="receiver_id",
        form_type="type",
        description="description",
    )
    owner = F.coalesce(account, sender, receiver)
    client = F.coalesce(blank_to_null("client_tx_id"), blank_to_null("client_transfer_id"))
    own = blank_to_null("tx_id")
    return payload.withColumns(
        {
            "account_id": owner,
            "transaction_type": F.coalesce(
                blank_to_null("transaction_type"), blank_to_null("type"), role
            ),
            "client_tx_id": F.coalesce(client, F.when(own.isNotNull(), hash_id("tx_id", F.lit("client")))),
            "tx_id": F.coalesce(
                own, F.when(client.isNotNull(), hash_id(owner, client, F.lit("single")))
            ),
            "currency": first_filled("currency", F.lit(DEFAULT_CURRENCY)),
            "extra": jsonmap.merge(jsonmap.keep_raw("extra_json"), form),
            "inner_label": jsonmap.inner_label("extra_json"),
        }
    ).drop("extra_json", "client_transfer_id")


def split_transfers(normalized):
    """One row per leg: a payload with sender and receiver yields two rows.

    The receiver leg gets ids derived from the sender leg, so a retried task repeats them.
    Only the short list of roles is exploded; the leg columns are computed above it.
    """
    both = blank_to_null("sender_id").isNotNull() & blank_to_null("receiver_id").isNotNull()
    roles = F.when(both, F.array(F.lit("sender"), F.lit("receiver"))).otherwise(
        F.array(F.lit("single"))
    )
    legs = normalized.withColumn("_role", F.explode(roles))
    receiver = F.col("_role") == "receiver"
    tags = jsonmap.additions(
        p2p_role=F.when(F.col("_role") != "single", F.col("_role")),
        counterparty_account_id=F.when(receiver, F.col("sender_id")).when(
            F.col("_role") == "sender", F.col("receiver_id")
        ),
        mirror_of=F.when(receiver, F.col("tx_id")),
    )

    def leg(mine, theirs):
        return F.when(receiver, theirs).otherwise(F.col(mine))

    return legs.withColumns(
        {
            "account_id": leg("account_id", F.col("receiver_id")),
            "client_tx_id": leg("client_tx_id", hash_id("tx_id", F.lit("receiver-client"))),
            "transaction_type": leg("transaction_type", F.lit("cash_in")),
            "tx_id": leg("tx_id", hash_id("tx_id", F.lit("receiver"))),
            "extra": jsonmap.merge("extra", tags),
        }
    ).drop("_role")


def classify(rows):
    """Add event date, direction, VND amount, channel and the reason a row is refused."""
    rows = rows.withColumns(
        {
            "event_date": event_date(
                F.col("event_date") if "event_date" in rows.columns else F.lit(None), "event_ts"
            ),
            "transaction_type": normalize_type("transaction_type"),
        }
    )
    rows = rows.withColumns(
        {
            "cash_direction": infer_direction("transaction_type", "inner_label", "amount"),
            "amount_vnd": amount_vnd("amount", "currency"),
            "channel": channel_or_default("merchant"),
        }
    )
    return rows.withColumn("reject_reason", reject_reason("raw_line" in rows.columns))


def reject_reason(lines=False):
    """Why a row is refused; with ``lines``, a line that did not parse is a reason of its own."""
    unreadable = F.col("raw_line").isNotNull() if lines else F.lit(False)
    return (
        F.when(unreadable, "unreadable_line")
        .when(blank_to_null("account_id").isNull(), "missing_account")
        .when(F.col("event_date").isNull(), "missing_date")
        .when(vnd_rate("currency").isNull(), "unsupported_currency")
        .when(to_number("amount", 0.0) == 0, "zero_amount")
        .when(to_amount("amount").isNull(), "amount_out_of_range")
    )


def accepted(classified):
    return classified.filter(F.col("reject_reason").isNull())


def rejected(classified):
    return classified.filter(F.col("reject_reason").isNotNull())


def to_ledger(rows):
    """Stored form: exact amount and one JSON text holding ids, type and direction.

    What the row has in columns is the default for names the JSON text lacks. A direction of
    its own counts only for rows without a type.
    """
    kind = normalize_type("transaction_type")
    own = {
        name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
        for name in ("transfer_id", "direction", "counterparty_account_id")
    }
    peer = first_filled(own["counterparty_account_id"], jsonmap.text_at("extra", "counterparty_account_id"))
    defaults = jsonmap.additions(
        client_tx_id="client_tx_id",
        transaction_type=kind,
        direction=F.coalesce(kind, F.lower(blank_to_null(own["direction"]))),
        transfer_id=own["transfer_id"],
        counterparty_account_id=peer,
    )
    stored = {
        "event_date": F.to_date("event_ts"),
        "amount": to_amount("amount"),
        "extra_json": jsonmap.encode(jsonmap.set_default("extra", defaults)),
        "transfer_id": own["transfer_id"],
        "direction": own["direction"],
        "counterparty_account_id": peer,
    }
    return rows.withColumns(stored).select(*LEDGER.fieldNames())


def decode_ledger(ledger):
    """Read form: the names kept inside ``extra_json`` become columns, with fallbacks."""
    rows = ledger.withColumn("extra", jsonmap.decode("extra_json"))
    kind = first_filled(jsonmap.text_at("extra", "transaction_type"), jsonmap.text_at("extra", "direction"))
    direction = first_filled("direction", jsonmap.text_at("extra", "direction"))
    return rows.withColumns(
        {
            "inner_label": first_filled(jsonmap.text_at("extra", "type"), jsonmap.text_at("extra", "direction")),
            "client_tx_id": first_filled(jsonmap.text_at("extra", "client_tx_id"), jsonmap.text_at("extra", "clientTxId")),
            "transaction_type": kind,
            "type": first_filled(jsonmap.text_at("extra", "form_type"), kind, direction),
            "description": jsonmap.text_at("extra", "description"),
            "transfer_id": first_filled("transfer_id", jsonmap.text_at("extra", "transfer_id")),
            "counterparty_account_id": first_filled(
                "counterparty_account_id", jsonmap.text_at("extra", "counterparty_account_id")
            ),
            "direction": direction,
            "event_date": F.coalesce("event_date", F.to_date("event_ts")),
            "amount": F.col("amount").cast("double"),
        }
    ).drop("extra_json")


def legs(payload):
    """The one way from payloads to ledger legs: ids, defaults, first wins, both legs.

    First wins runs on normalised rows, so that the key is the account that sends and the
    client's id whichever field brought it.
    """
    return split_transfers(first_wins(normalize_payload(draw_ids(payload))))


def cash_legs(payload):
    """Classified legs; ``accepted`` and ``rejected`` part them."""
    return classify(legs(payload))


def ingest(payload):
    """Payloads to (ledger rows, rejects): legs without account or date, with an unsupported
    currency or without a usable amount are kept apart with their reason."""
    classified = cash_legs(payload)
    return to_ledger(accepted(classified)), rejected(classified)


def split_in_out(rows):
    """Amount pivoted into cash_in / cash_out columns by direction, for roll-up."""
    amount = F.col("amount_vnd")
    zero = F.lit(0).cast("decimal(38,2)")
    return rows.withColumns(
        {
            "date": F.col("event_date"),
            "cash_in": F.when(F.col("cash_direction") == "cash_in", amount).otherwise(zero),
            "cash_out": F.when(F.col("cash_direction") == "cash_out", amount).otherwise(zero),
        }
    )


def missing_columns(df, required):
    return sorted(set(required) - set(df.columns))


def require_cash_columns(df):
    """Daily staging as is; raw transactions are converted; anything else is an error."""
    if not missing_columns(df, ("date", "cash_in", "cash_out")):
        return df
    if missing_columns(df, ("amount", "transaction_type")):
        raise ValueError(f"missing columns: {missing_columns(df, ('date', 'cash_in', 'cash_out'))}")
    optional = {
        name: F.lit(None).cast("string")
        for name in ("account_id", "currency", "merchant", "event_ts", "event_date")
        if name not in df.columns
    }
    if "inner_label" not in df.columns:
        raw = F.col("extra_json") if "extra_json" in df.columns else F.lit(None).cast("string")
        optional["inner_label"] = jsonmap.inner_label(raw)
    if "date" in df.columns:
        optional["event_date"] = F.col("date")
    return split_in_out(classify(df.withColumns(optional))).filter(F.col("date").isNotNull())
