"""Transaction type labels and cash direction."""

from pyspark.sql import functions as F

from cashtide.functions.clean import blank_to_null, strip, text, to_number

# Accepted spellings of the two directions.
CASH_IN_LABELS = ("cash_in", "in", "deposit", "cashin")
CASH_OUT_LABELS = ("cash_out", "out", "withdraw", "withdrawal", "cashout")




def _canonical(label):
    """One literal lookup: known spellings to their direction, anything else to null."""
    pairs = [(name, "cash_in") for name in CASH_IN_LABELS]
    pairs += [(name, "cash_out") for name in CASH_OUT_LABELS]
    return F.create_map(*[F.lit(part) for pair in pairs for part in pair])[label]


def normalize_type(value):
    """``cash_in`` / ``cash_out`` for known spellings, otherwise the cleaned label."""
    label = F.lower(strip(value))
    return F.coalesce(_canonical(label), blank_to_null(label))


def infer_direction(transaction_type, inner_label, amount):
    """Direction by type label, else by the label inside the extra JSON, else by sign."""
    by_sign = F.when(to_number(amount, 0.0) < 0, "cash_out").otherwise("cash_in")
    known = [_canonical(F.lower(strip(label))) for label in (transaction_type, inner_label)]
    return F.coalesce(*known, by_sign)


def class_label(form_type):
    """Who moved the money: a customer transfer, the treasury desk, or unknown."""
    form_type = text(form_type)
    return (
        F.when(form_type == "p2p", "customer")
        .when(form_type.isin("cash_in", "cash_out"), "treasury")
        .otherwise("unknown")
    )
