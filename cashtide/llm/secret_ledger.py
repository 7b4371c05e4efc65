"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds one row
for each (blob, rule version) scanned so far with the spans found. A scan takes one copy of
each blob that the ledger lacks under the current rule version, looks for secrets in it, adds
the rows, and joins the findings of all blobs back to all paths. Bumping a rule set's version
makes every blob unseen again for that set only.

Offsets come from splitting a text at the matches: the pieces between matches and the matches
themselves add up to each position, in code points.

Null text counts as empty and yields no spans. Each input row gives one result row, repeated
rows and null ids included; an empty table gives an empty result; key columns are carried
along, further columns are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import documents, span_text

SPAN = "struct<kind:string,start:bigint,`end`:bigint>"
SPANS = f"array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, without overlap. When ``value_length`` is set, matches
    whose group 2 is shorter are dropped and not tried again."""

    kind: str
    pattern: str
    value_length: int = 0


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple


# The kinds in their order. A run shorter than the least length cannot match in
# part, so for runs of one class the least length stands in the pattern.
BASE_RULES = RuleSet(
    "base-1",
    (
        Rule(
            "assign",
            "(?i:(password|passwd|secret|token|api_?key))"
            "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            12,
        ),
        Rule("access", "AKIA[A-Z0-9]{14,}"),
        Rule("hex", "[0-9a-f]{16,}"),
    ),
)


def blob_id(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def rule_spans(text, rule):
    """Spans of one rule as an array, empty for most texts after one pass."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if rule.value_length else found
    pieces = F.split(text, rule.pattern, -1)
    lengths = F.transform(
        F.arrays_zip(pieces.alias("piece"), found.alias("match"), value.alias("value")),
        lambda x: F.struct(
            F.length(x["piece"]).cast("bigint").alias("gap"),
            F.coalesce(F.length(x["match"]), F.lit(0)).cast("bigint").alias("size"),
            F.coalesce(F.length(x["value"]), F.lit(0)).alias("value"),
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(held, x):
        begin = held["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end"))
        keep = (x["size"] > 0) & (x["value"] >= rule.value_length)
        return F.struct(
            end.alias("at"),
            F.when(keep, F.concat(held["spans"], F.array(span)))
            .otherwise(held["spans"])
            .alias("spans"),
        )

    spans = F.aggregate(lengths, start, step, lambda held: held["spans"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def text_spans(text, rules):
    """All spans of a text by start, then by the order of the rules."""
    order = {rule.kind: i for i, rule in enumerate(rules.rules)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    every = F.concat(*[rule_spans(text, rule) for rule in rules.rules])
    keyed = F.transform(
        every,
        lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["end"], s["kind"]),
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"])
    ).cast(SPANS)


def unseen(versions, ledger, rules):
    """One (blob, text) for each blob not in the ledger under this rule version.

    A blob's smallest key names the copy to read, so texts travel once and a hot blob's
    copies fall away before they do.
    """
    copies = versions.select("key", blob_id(F.col("text")).alias("blob"))
    first = copies.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        done = ledger.filter(F.col("rule_version") == rules.version).select("blob")
        first = first.join(done, "blob", "left_anti")
    first = first.select(F.col("blob").alias("first_blob"), F.col("key").alias("first_key"))
    texts = versions.select(
        "key", blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")
    )
    same = (F.col("blob") == F.col("first_blob")) & F.col("key").eqNullSafe(F.col("first_key"))
    return texts.join(first.hint("shuffle_hash"), same, "left_semi").select("blob", "text")


def scan(versions, rules=BASE_RULES, ledger=None):
    """Ledger rows (blob, rule_version, spans) for what ``ledger`` has not seen yet.

    ``versions`` has ``key`` (one per path and version, of any orderable type) and ``text``.
    """
    found = unseen(versions, ledger, rules).select(
        "blob", F.lit(rules.version).alias("rule_version"), text_spans(F.col("text"), rules).alias("spans")
    )
    # Rows repeated with their key bring the same blob twice.
    return found.dropDuplicates(["blob"])


def findings(versions, ledger, rules=BASE_RULES):
    """Every version with the spans of its blob."""
    held = ledger.filter(F.col("rule_version") == rules.version).select("blob", "spans")
    paths = versions.select("key", blob_id(F.col("text")).alias("blob"))
    return paths.join(held, "blob", "left")


def update(versions, rules=BASE_RULES, ledger=None):
    """The findings of all ``versions`` and the new ledger, stored in the shared folder."""
    fresh = scan(versions, rules, ledger)
    if ledger is not None:
        fresh = ledger.unionByName(fresh)
    stored = session.cut(fresh, "secret-ledger")
    return findings(versions, stored, rules), stored


def digest(found, rules=BASE_RULES):
    """Per document: matches of each kind, and the spans as text and as a checksum."""
    text = span_text(F.col("spans"))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(rule.kind).alias(f"n_{rule.kind}") for rule in rules.rules]
    return found.select(
        F.col("key").alias("doc_id"), *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans")
    )


def op10_secret_ledger(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    found, _ = update(docs)
    return digest(found)


OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
assign AS (
  SELECT doc_id, 'assign' AS kind, 1 AS pos,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g,
    12 AS least FROM t),
access AS (
  SELECT doc_id, 'access' AS kind, 2 AS pos, regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS m,
    m AS v, string_split_regex(text, 'AKIA[A-Z0-9]+') AS g, 18 AS least FROM t),
hex AS (
  SELECT doc_id, 'hex' AS kind, 3 AS pos, regexp_extract_all(text, '[0-9a-f]+') AS m,
    m AS v, string_split_regex(text, '[0-9a-f]+') AS g, 16 AS least FROM t),
matches AS (
  SELECT doc_id, kind, pos, least, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g,
    unnest(range(len(m))) AS i
  FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)),
placed AS (
  SELECT doc_id, kind, pos, least, v, length(m) AS n,
    sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM matches),
kept AS (
  SELECT doc_id, kind, pos, (stop - n)::BIGINT AS start, stop::BIGINT AS stop
  FROM placed WHERE length(v) >= least),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, pos) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM t LEFT JOIN lists USING (doc_id)
"""
