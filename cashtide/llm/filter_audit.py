"""How filters interact: what each removes, in every order of applying them.

Five filters are judged once per document. Four need the document alone and give a bit each; the
fifth, "identical to a text with a smaller id", needs the whole table. For it a counting-Bloom
sketch clears most texts: each task counts, saturating at two, the cells that its texts touch, the
sketches are added block by block, and a text one of whose cells was touched once is unique. Only the
others, the possible repeats, shuffle to find the least id of each full text exactly. A full text
goes by its SHA-256 there and everywhere, so no text ever moves.

The sketch has a number of cells in proportion to the documents up to ``MOST_CELLS`` and reaches the
tasks as one bit a cell, 32 MB at most. Beyond that it clears fewer texts and more rows of some
40 bytes shuffle; results never depend on it.

A document then is a mask of five bits. Everything that is asked is a sum over documents of a
condition on the mask, so the documents are added up per (part, mask) first and the 120 orders are
worked out on at most 32 rows a part.

Null text counts as empty. A null id is neither smaller nor larger than another, so it neither makes
nor is a repeat; rows with equal id and text are not repeats of each other. A label counts when any
row of ``labels`` gives it; labels of a null id are nobody's. Null ``lang`` is the part of the empty string. An empty table gives an
empty result; further columns are ignored.
"""

import hashlib
import itertools
import json
import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import documents, in_arrow, utf8
from cashtide.sources.tables import table

# The filters' letters, the bit of a letter is its place, and their limits.
LETTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SIGNS = b"#$%&*|"
REPEATED = 1 << LETTERS.index("E")

#: Cells of the sketch: for each document, in one block, at most; and cells that a text touches.
CELLS_A_TEXT = 8
BLOCK_CELLS = 1 << 16
MOST_CELLS = 1 << 28
TOUCHED = 3
#: Texts that a task holds before it hands on their cells.
HELD_TEXTS = 500_000

JUDGED = "doc_id bigint, part string, mask int, digest binary"
MARKED = f"{JUDGED}, maybe boolean"
PARTIAL = "block int, cells binary, counts binary"
CROWDED = "block int, bits binary"

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_sign = re.compile(b"[" + re.escape(SIGNS) + b"]").search


def own_mask(data):
    """The bits of the four filters that a text fails by itself."""
    words = data.split()
    distinct = len(set(words))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.decode("utf-8", "replace"))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * distinct < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | (_sign(data) is not None) << 3
    )


def _judging(batches):
    for batch in batches:
        texts = [data or b"" for data in utf8(batch.column(1))]
        yield {
            "doc_id": batch.column(0),
            "part": batch.column(2),
            "mask": [own_mask(data) for data in texts],
            "digest": [hashlib.sha256(data).digest() for data in texts],
        }


def judged(docs):
    """Per document: id, part, mask of the filters A to D, and the digest of its text."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return in_arrow(docs.select("doc_id", "text", part), _judging, JUDGED)


def cells_for(n):
    """A power of two, at least one block."""
    wanted = max(BLOCK_CELLS, CELLS_A_TEXT * n)
    return min(MOST_CELLS, 1 << (wanted - 1).bit_length())


def touched(digests, cells):
    """The cells of each digest, one row each."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :TOUCHED]
    return (words & np.uint64(cells - 1)).astype(np.int64)


def _counting(cells):
    def task(batches):
        held, texts = [], 0

        def partial():
            at, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, 2).astype(np.uint8)
            blocks = at // BLOCK_CELLS
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            ends = np.append(starts[1:], len(at))
            return {
                "block": blocks[starts].astype(np.int32).tolist(),
                "cells": [
                    (at[a:b] % BLOCK_CELLS).astype("<u2").tobytes()
                    for a, b in zip(starts, ends, strict=True)
                ],
                "counts": [counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
            }

        for batch in batches:
            if batch.num_rows:
                held.append(touched(batch.column(0).to_pylist(), cells).ravel())
                texts += batch.num_rows
            if texts >= HELD_TEXTS:
                yield partial()
                held, texts = [], 0
        if held:
            yield partial()

    return task


def _merging(batches):
    """Add up the partial counts of the blocks that were dealt to this task."""
    sums = {}
    for batch in batches:
        for row in batch.to_pylist():
            total = sums.setdefault(row["block"], np.zeros(BLOCK_CELLS, np.uint8))
            at = np.frombuffer(row["cells"], "<u2")
            total[at] = np.minimum(total[at] + np.frombuffer(row["counts"], np.uint8), 2)
    yield {
        "block": list(sums),
        "bits": [np.packbits(total > 1).tobytes() for total in sums.values()],
    }


def crowded_cells(rows, cells):
    """One bit a cell, set where two texts or more touch it."""
    partial = in_arrow(rows.select("digest"), _counting(cells), PARTIAL)
    merged = in_arrow(partial.repartition("block"), _merging, CROWDED)
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.collect():  # as many rows as blocks, 32 MB at most
        at = row["block"] * BLOCK_CELLS // 8
        bits[at : at + BLOCK_CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _clearing(held, cells):
    def task(batches):
        bits = held.value
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            maybe = []
            if batch.num_rows:
                at = touched(columns["digest"].to_pylist(), cells)
                full = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
                maybe = full.all(axis=1).tolist()
            yield columns | {"maybe": maybe}

    return task


def with_repeats(rows, cells=None):
    """The rows of ``judged`` with the repeat's bit added to their masks."""
    spark = rows.sparkSession
    cells = cells or cells_for(rows.count())
    held = spark.sparkContext.broadcast(crowded_cells(rows, cells))
    marked = session.cut(in_arrow(rows, _clearing(held, cells), MARKED), "possible-repeats")
    unique = marked.filter("NOT maybe").drop("maybe")
    maybe = marked.filter("maybe").drop("maybe")
    least = (
        maybe.groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
        .filter("last > least")
        .select("digest", "least")
    )
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    repeats = maybe.join(least, "digest", "left").withColumn(
        "mask", F.col("mask") + F.when(later, REPEATED).otherwise(0)
    )
    return unique.unionByName(repeats.drop("least"))


def with_labels(rows, labels):
    """Rows with ``good`` and ``toxic``, 1 where a label says so."""
    said = (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
        .withColumn("known", F.lit(True))
    )
    # Rows without an id would meet in one task; they go by their digest and match no label.
    keyed = rows.withColumns(
        {
            "id": F.coalesce("doc_id", F.xxhash64("digest")),
            "known": F.col("doc_id").isNotNull(),
        }
    )
    zero = F.lit(0)
    return (
        keyed.join(said, ["id", "known"], "left")
        .drop("id", "known")
        .withColumns({"good": F.coalesce("good", zero), "toxic": F.coalesce("toxic", zero)})
    )


def mask_counts(docs, labels, cells=None):
    """Documents, good ones and toxic ones per (part, mask)."""
    rows = session.cut(judged(docs), "judged")
    rows = with_labels(with_repeats(rows, cells), labels)
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )


def steps(letters=LETTERS):
    """Every step of every order: its filter's bit and the bits applied before it."""
    out = []
    for order in itertools.permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def interactions(masks):
    """The audit's rows from the counts per (part, mask)."""
    kind = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    each = masks.select("*", F.inline(F.from_json(F.lit(json.dumps(steps())), kind)))

    def has(bits):
        return F.col("mask").bitwiseAND(bits) != 0

    fails, earlier = has(F.col("bit")), has(F.col("before"))
    removed = fails & ~earlier

    def total(condition, what="n"):
        return F.sum(F.when(condition, F.col(what)).otherwise(0))

    audit = each.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    everywhere = Window.partitionBy("part", "bit")
    return audit.withColumn("shapley", F.sum("removed").over(everywhere)).drop("bit")


def audit(docs, labels, cells=None):
    """Per part, order and step: kept, removed, redundant, unique and label losses, and the sum of
    removals over all orders."""
    return interactions(session.cut(mask_counts(docs, labels, cells), "mask-counts"))


def op12_filter_audit(spark, sf_dir):
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
least_id AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id),
m AS (SELECT w.part,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t))::INT
    + 8 * regexp_matches(w.t, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > least, false)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN least_id l ON l.t = w.t LEFT JOIN said s ON s.doc_id = w.doc_id),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS letters,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT array_to_string(letters, '') AS filter_order, i AS step, bits[i] AS bit,
    coalesce(list_sum(bits[1:i - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) r(i)),
audit AS (SELECT part, filter_order, step::INT AS step, bit,
    sum(n) FILTER (WHERE mask & (bit + earlier) = 0) AS kept,
    sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept,
  coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM audit
"""
