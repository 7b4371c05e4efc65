"""JSON objects kept in text columns, handled as ``map<string,variant>``.

Variants keep numbers, booleans, nulls and nested values as they came.
"""

from pyspark.sql import functions as F

from cashtide.functions.clean import blank_to_null, text

_MAP = "map<string,variant>"


def empty_map():
    return F.from_json(F.lit("{}"), _MAP)


def of_texts(value):
    """A map of texts as a JSON map."""
    return text(value).cast(_MAP)


def text_at(value, key):
    """The value under a key as text: null for an absent key and for a JSON null."""
    return text(value)[key].cast("string")


def decode(value):
    """Null for null, empty, unreadable or non-object text."""
    return F.from_json(blank_to_null(text(value)), _MAP)


def inner_label(value):
    """``type`` or else ``direction`` of a JSON object in text; reads just those two fields."""
    fields = F.from_json(blank_to_null(text(value)), "type string, direction string")
    return _bind(lambda f: F.coalesce(_some(f["type"]), _some(f["direction"])), fields)


def encode(value):
    return F.to_json(text(value))


def _filled(value):
    return F.coalesce(text(value), empty_map())


def _without_nulls(value):
    return F.map_filter(value, lambda _, v: v.isNotNull() & ~F.is_variant_null(v))


def _some(value):
    return F.when(value != "", value)


def _or_null(value):
    return F.when(F.size(value) > 0, value)


def additions(**pairs):
    """A map of additions with null and empty values left out."""
    entries = [part for key, v in pairs.items() for part in (F.lit(key), blank_to_null(v))]
    filled = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return of_texts(filled)


def _bind(fn, *values):
    """Evaluate the arguments once and hand them to ``fn`` as lambda variables.

    Without this each use of an argument would copy its whole expression into the plan.
    """
    packed = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    bound = F.transform(packed, lambda s: fn(*[s[f"v{i}"] for i in range(len(values))]))
    return F.get(bound, 0)


def _overlay(low, high):
    """All entries of ``high`` and those of ``low`` under other keys; null when empty."""

    def combine(low, high, taken):
        kept = F.map_filter(low, lambda k, _: ~F.array_contains(taken, k))
        return F.map_concat(kept, high)

    joined = _bind(
        lambda low, high: _bind(combine, low, high, F.map_keys(high)), _filled(low), _filled(high)
    )
    return _bind(_or_null, joined)


def merge(base, added):
    """Additions win, null additions are skipped, an empty result is null."""
    return _overlay(base, _without_nulls(_filled(added)))


def set_default(base, defaults):
    """Keys already present win, even with a null value."""
    return _overlay(_without_nulls(_filled(defaults)), base)


def keep_raw(value):
    """Decoded object, or the raw text under ``raw_extra`` when it is not an object."""
    raw = blank_to_null(text(value))
    wrapped = of_texts(F.create_map(F.lit("raw_extra"), raw))
    return F.coalesce(decode(value), F.when(raw.isNotNull(), wrapped))
