"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds all word sequences of the normalised items. Each task streams its
documents' words through it and follows the length of the longest match that ends at each
word: where it reaches a window's length, the window's words are hit. Words that no item has
reset the match, so only runs of known words are walked.

Items are dealt by hash into blocks of about ``BLOCK_WORDS`` words or fewer, each with an
automaton of its own. The documents pass them one after another and are written between passes,
so that the driver holds one block at a time and each task one automaton, whatever the benchmark.

Null or wordless items have no windows; an item that is repeated counts once. Null or
wordless documents have no hits and are clean. Repeated rows and null ids pass through; an empty
table gives an empty result; further columns are ignored, or kept by ``clean``.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cashtide import session
from cashtide.llm.common import documents, in_arrow, utf8
from cashtide.sources.tables import table

WINDOW = 13
#: Hit words at least 1/20 of all words make a document contaminated.
COVERAGE = 20
BLOCK_WORDS = 500_000

# Lower-cases A-Z and turns every other ASCII character but digits and a-z into a blank.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: The columns of a scan beside ``row``, which holds what the caller wants carried along.
SCANNED = "text binary, n_words bigint, hits binary, items array<string>"
RESULT = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
)


def words_of(data):
    return (data or b"").translate(LETTERS).split()


class Automaton:
    """Suffix automaton of many word sequences, with the items that each window occurs in."""

    def __init__(self, items, window=WINDOW):
        """``items``: pairs (item id as text, words)."""
        self.window = window
        self.number = {}
        self.step, self.link, self.length = [{}], [-1], [0]
        self.items = [()]
        # Whole short items by the state that they end in, whose longest sequence they are.
        ends = {}
        shortest = window
        sequences = []
        for item, words in items:
            if words:
                ids = [self.number.setdefault(w, len(self.number)) for w in words]
                sequences.append((item, ids))
                shortest = min(shortest, len(ids))
        for _, ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.least = shortest
        found = [set() for _ in self.step]
        for item, ids in sequences:
            state = 0
            for w in ids:
                state = self.step[state][w]
                at = state
                while at > 0 and item not in found[at]:
                    found[at].add(item)
                    at = self.link[at]
            if len(ids) < window:
                ends.setdefault(state, set()).add(item)
        self.full, self.short = {}, {}
        for state in range(1, len(self.step)):
            at, short = state, []
            while at > 0:
                if at in ends:
                    short.append((self.length[at], frozenset(ends[at])))
                if self.length[self.link[at]] < window <= self.length[at]:
                    self.full[state] = at
                at = self.link[at]
            if short:
                self.short[state] = short
        self.items = {at: frozenset(found[at]) for at in set(self.full.values())}

    def _extend(self, last, w):
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            known = step[last][w]
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, w, known)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at >= 0:
            known = step[at][w]
            link[new] = known if length[known] == length[at] + 1 else self._clone(at, w, known)
        return new

    def _clone(self, at, w, known):
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[known]))
        link.append(link[known])
        length.append(length[at] + 1)
        link[known] = copy
        while at >= 0 and step[at].get(w) == known:
            step[at][w] = copy
            at = link[at]
        return copy

    def match(self, words):
        """Hit spans (from, to) of a document, in order and without overlap, and its items."""
        get, least, window = self.number.get, self.least, self.window
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        spans, items = [], set()
        step, link, length, full, short = self.step, self.link, self.length, self.full, self.short
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < least:
                continue
            state = matched = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin + 1):
                after = step[state].get(w)
                while after is None and state:
                    state = link[state]
                    matched = length[state]
                    after = step[state].get(w)
                if after is None:
                    continue
                state, matched = after, matched + 1
                size = 0
                if matched >= window:
                    # The item words match as far back as the window's length.
                    size = window
                    items |= self.items[full[state]]
                for n, which in short.get(state, ()):
                    if n <= matched:
                        size = max(size, n)
                        items |= which
                if size:
                    start = i - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items


def _words_task(batches):
    for batch in batches:
        words = [words_of(data) for data in utf8(batch.column(1))]
        yield {
            "item": batch.column(0), "words": [b" ".join(w) for w in words],
            "n": [len(w) for w in words],
        }


def item_blocks(items, block_words=BLOCK_WORDS):
    """The benchmark in blocks of whole items, read one block at a time; at least one block."""
    held = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    words = in_arrow(held, _words_task, "item string, words binary, n bigint")
    words = words.filter("n > 0").distinct()
    total = words.agg(F.sum("n")).first()[0] or 0
    # Twice as many blocks as needed, since a hash deals them out unevenly.
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for k in range(blocks):
        rows = words.filter(block == k).select("item", "words").collect()
        if rows or blocks == 1:
            yield [(r[0] or "", bytes(r[1])) for r in rows]


def _scan_task(held, window):
    def task(batches):
        automaton = Automaton([(i, w.split()) for i, w in held.value], window)
        for batch in batches:
            n_words, hits, items = [], [], []
            texts = batch.column("text")
            known = batch.column("items").to_pylist()
            for data, before, old in zip(utf8(texts), utf8(batch.column("hits")), known):
                words = words_of(data)
                spans, found = automaton.match(words)
                mark = before
                if spans:
                    flags = np.zeros(len(words), bool)
                    for a, b in spans:
                        flags[a:b] = True
                    if before:
                        flags |= np.unpackbits(np.frombuffer(before, np.uint8))[: len(words)] > 0
                    mark = np.packbits(flags).tobytes()
                n_words.append(len(words))
                hits.append(mark)
                items.append(sorted(found.union(old or ())))
            yield {
                "row": batch.column("row"), "text": texts, "n_words": n_words,
                "hits": hits, "items": items,
            }

    return task


def _sum_task(coverage):
    def task(batches):
        for batch in batches:
            rows = []
            for n, mark, items in zip(
                batch.column("n_words").to_pylist(),
                utf8(batch.column("hits")),
                batch.column("items").to_pylist(),
            ):
                hit = int(np.unpackbits(np.frombuffer(mark, np.uint8)).sum()) if mark else 0
                digest = hashlib.sha256(",".join(items or ()).encode()).hexdigest()
                rows.append((hit, len(items or ()), digest, hit > 0 and coverage * hit >= n))
            yield {
                "row": batch.column("row"), "n_words": batch.column("n_words"),
                "n_hit": [r[0] for r in rows], "n_items": [r[1] for r in rows],
                "items_sha256": [r[2] for r in rows], "contaminated": [r[3] for r in rows],
            }

    return task


def _with_row(found, columns):
    """A result schema of ``found``'s carried row and further columns."""
    return StructType([found.schema["row"], *StructType.fromDDL(columns).fields])


def scan(docs, items, carry, window=WINDOW, block_words=BLOCK_WORDS):
    """Documents with their number of words, a bit per hit word, and the items found.

    The columns named in ``carry`` come along in ``row``, so that none can clash.
    """
    spark = docs.sparkSession
    found = docs.select(
        F.struct(*carry).alias("row"),
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(b"").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    held = path = None
    for block in item_blocks(items, block_words):
        if held:
            before, path = path, session.store(found, "scanned")
            found = spark.read.schema(found.schema).parquet(path)
            held.destroy()
            if before:
                session.discard(spark, before)
        held = spark.sparkContext.broadcast(block)
        found = in_arrow(found, _scan_task(held, window), _with_row(found, SCANNED))
    return found


def contamination(docs, items, carry=("doc_id",), coverage=COVERAGE, **more):
    """Per document: the carried ``row``, words, hit words, items, and the verdict."""
    found = scan(docs, items, carry, **more).drop("text")
    return in_arrow(found, _sum_task(coverage), _with_row(found, RESULT))


def keep_clean(docs, items, **more):
    """The rows of ``docs`` that are not contaminated."""
    judged = contamination(docs, items, carry=docs.columns, **more)
    return judged.filter("NOT contaminated").select("row.*")


def _cut_task(coverage, least):
    def task(batches):
        for batch in batches:
            out = []
            for data, mark in zip(utf8(batch.column("text")), utf8(batch.column("hits"))):
                words = words_of(data)
                flags = np.unpackbits(np.frombuffer(mark or b"", np.uint8))[: len(words)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0]))))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                whole = coverage * flags.sum() >= len(words)
                gone = [s for s in spans if whole or s[1] - s[0] > least]
                out.append(_without(data, gone))
            yield {"row": batch.column("row"), "text": out}

    return task


def _without(data, spans):
    """A text without the given spans of words."""
    if data is None or not spans:
        return data
    plain, places, at = data.translate(LETTERS), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    kept, begin = [], 0
    for a, b in spans:
        kept.append(data[begin : places[a][0]])
        begin = places[b - 1][1]
    return b"".join([*kept, data[begin:]])


def remove_spans(docs, items, coverage=COVERAGE, least=WINDOW, **more):
    """(doc_id, text) without hit spans of more than ``least`` words, or without any hit span
    where the hits reach the coverage limit."""
    found = scan(docs, items, ("doc_id",), **more)
    cut = in_arrow(found, _cut_task(coverage, least), _with_row(found, "text binary"))
    return cut.select("row.doc_id", F.col("text").cast("string").alias("text"))


def op5_benchmark_overlap(spark, sf_dir):
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])
