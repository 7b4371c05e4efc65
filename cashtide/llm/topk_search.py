"""Exact BM25 top-k search: inverted index shards with block-max pruning.

Each task turns its documents into index shards: per term (a 64-bit hash of a lower-cased word) the
postings (document, frequency), sorted by document. Shards are independent rows of a Parquet
table and hold whole texts of all documents.

Queries are answered in blocks of a bounded number of words. A first pass over the shards sums the
number of documents of each query term, so that all shards score with the same global
statistics. In the second pass a task takes shard after shard, and batch after batch of queries.
Terms that a good part of the shard holds are rows of contributions, which one matrix product sums
for all documents and queries of the batch. A query whose best sum there and the maxima of its other
terms stay below its k-th best score in the task is done with the shard (the WAND condition); else
the other terms' postings are added. Then the k-th best of the maxima over blocks of documents
bounds the k-th best score, and only blocks that reach it are searched for documents. The best of a
task's shards are merged in the task, those of the tasks by score.

Scores are rounded to nine decimals; ties go to the smaller doc_id. A query's words count
once. Null or wordless texts match nothing and, as queries, find nothing; so does a query none of
whose words occur. Repeated rows are documents, and queries, of their own; rows with a null id are
documents but no queries. An empty table gives an empty result; further columns are ignored.
"""

from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import Memo, documents, in_arrow, utf8, worker_state

K1, B = 1.2, 0.75
TOP = 10
EVERY = 100
#: Documents and postings of one shard, documents of one block at most.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 2048, 2_000_000, 64
#: Documents and postings up to which shards are searched as one.
JOINED_DOCS, JOINED_POSTINGS = 16_384, 6_000_000
#: Query words answered together; queries in one matrix product of a shard, and ranked together.
QUERY_WORDS, QUERY_ROWS, SCORE_ROWS = 4_000_000, 512, 64
#: Words in at least this share of a shard get a dense row; at most so many, and so many numbers.
COMMON, COMMON_WORDS, COMMON_CELLS = 0.05, 4096, 1 << 24
#: Postings that are worked out or added up at once.
STRIP = 1 << 15
#: Words whose counts travel together; partitions of the index for one task, beyond two tasks a core.
COUNTED, TASK_PARTS = 1 << 14, 8
#: Scores this much apart may be equal when rounded.
SLACK = 2e-9
REMEMBERED = 500_000

SHARD = (
    "doc_ids binary, known binary, lengths binary, terms binary, starts binary, docs binary, "
    "counts binary"
)
HITS = "query_id bigint, query_no bigint, doc_id bigint, known boolean, score double"


HASH = xxhash.xxh3_64_intdigest


def _split(data):
    """The words of a text: runs without ASCII white space, A-Z lower-cased."""
    return (data or b"").lower().split()


def words_of(data):
    """Hashes of the words of a text."""
    number = worker_state("search_words", lambda: Memo(HASH, REMEMBERED))
    return np.array([number[w] for w in _split(data)], np.uint64)


def _cell(values, kind):
    """An array of one binary value, over the bytes of ``values`` without a copy."""
    data = pa.py_buffer(np.ascontiguousarray(values, kind))
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], "<i4")), data])


def _packed(held):
    """One shard row of (doc_id, length, terms, counts) entries, which are taken out of ``held``."""
    doc_ids, lengths, terms, counts = zip(*held)
    held.clear()
    sizes = [len(t) for t in terms]
    terms, counts = np.concatenate(terms), np.concatenate(counts)
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    doc = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)[order]
    new = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))[: len(terms)])
    return {
        "doc_ids": _cell([i or 0 for i in doc_ids], "<i8"),
        "known": _cell([i is not None for i in doc_ids], np.uint8),
        "lengths": _cell(lengths, "<i8"),
        "terms": _cell(terms[new], "<u8"),
        "starts": _cell(np.append(new, len(terms)), "<i8"),
        "docs": _cell(doc, "<u2"),
        "counts": _cell(counts, "<u4"),
    }


def _index_task(batches):
    held, postings = [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            counts = Counter(_split(data))
            terms = np.fromiter(map(HASH, counts), np.uint64, len(counts))
            counts = np.fromiter(counts.values(), "<u4", len(counts))
            held.append((doc_id, int(counts.sum()), terms, counts))
            postings += len(terms)
            if len(held) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield _packed(held)
                postings = 0
    if held:
        yield _packed(held)


def build_index(docs):
    """The index shards of all documents, stored in the shared folder."""
    return session.cut(in_arrow(docs.select("doc_id", "text"), _index_task, SHARD), "index")


def places(row, vocabulary):
    """Where the words of a vocabulary are among a shard's terms (-1: nowhere), and where the
    postings of its terms start."""
    terms, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<i8")
    place = np.full(len(vocabulary), -1)
    if len(terms) < len(vocabulary):
        at = np.searchsorted(vocabulary, terms)
        found = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms)
        place[at[found]] = found
    elif len(terms):
        at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
        place = np.where(terms[at] == vocabulary, at, -1)
    return place, starts


def document_counts(place, starts):
    """(query word, documents of this shard that hold it)."""
    held = np.flatnonzero(place >= 0)
    at = place[held]
    return held, starts[at + 1] - starts[at]


class IndexShards:
    """Some shards, as one, with the vocabulary of a block of queries.

    Postings outlive ``__init__`` as contributions alone: in a dense row for a common word, one after
    the other for a rare one. They are worked out a strip at a time, so that no step holds more than
    a strip.
    """

    def __init__(self, rows, vocabulary, weight, mean_length):
        def column(row, name, kind):
            return np.frombuffer(row[name], kind)

        self.doc_ids = np.concatenate([column(row, "doc_ids", "<i8") for row in rows])
        self.known = np.concatenate([column(row, "known", np.uint8) for row in rows]).astype(bool)
        lengths = np.concatenate([column(row, "lengths", "<i8") for row in rows])
        self.norm = K1 * (1 - B + B * lengths / mean_length)
        n, parts, offset, sizes = len(lengths), [], 0, np.zeros(len(vocabulary), np.int64)
        for row in rows:
            place, starts = places(row, vocabulary)
            held, held_sizes = document_counts(place, starts)
            sizes[held] += held_sizes
            docs, counts = column(row, "docs", "<u2"), column(row, "counts", "<u4")
            parts.append((held, held_sizes, starts[place[held]], docs, counts, offset))
            offset += len(row["lengths"]) // 8
        held = np.flatnonzero(sizes)
        sizes, self.weight = sizes[held], weight[held]
        self.row = np.full(len(weight), -1, np.int32)
        self.row[held] = np.arange(len(held))
        common = np.flatnonzero(sizes >= COMMON * n)
        most = min(COMMON_WORDS, COMMON_CELLS // n)
        if len(common) > most:
            common = np.sort(common[np.argsort(-sizes[common], kind="stable")[:most]])
        self.common_row = np.full(len(held), -1)
        self.common_row[common] = np.arange(len(common))
        # Frequencies, and contributions in single precision, of the common words.
        highest = max((int(part[4].max()) for part in parts if len(part[4])), default=0)
        self.tf = np.zeros((len(common), n), np.min_scalar_type(highest))
        self.near = np.zeros((len(common), n), np.float32)
        # Postings of a rare word lie from its start on; a common one has none here.
        self.sizes = np.where(self.common_row < 0, sizes, 0)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.docs, self.gain = np.empty(int(self.sizes.sum()), "<u2"), np.empty(int(self.sizes.sum()))
        self.largest = np.zeros(len(held))
        fill = self.start.copy()
        for held, held_sizes, first, docs, counts, offset in parts:
            for low, high in _strips(held_sizes):
                words, sizes = self.row[held[low:high]], held_sizes[low:high]
                at = _ranges(first[low:high], sizes)
                doc, tf = docs[at].astype(np.int64) + offset, counts[at]
                gain = self._gain(np.repeat(words, sizes), doc, tf)
                row = np.repeat(self.common_row[words], sizes)
                dense = row >= 0
                self.tf[row[dense], doc[dense]] = tf[dense]
                self.near[row[dense], doc[dense]] = gain[dense]
                rare = self.common_row[words] < 0
                words, sizes = words[rare], sizes[rare]
                if len(words):
                    doc, gain, to = doc[~dense], gain[~dense], _ranges(fill[words], sizes)
                    self.docs[to], self.gain[to] = doc, gain
                    largest = np.maximum.reduceat(gain, np.cumsum(sizes) - sizes)
                    self.largest[words] = np.maximum(self.largest[words], largest)
                    fill[words] += sizes

    def _gain(self, words, docs, counts):
        """What words contribute to documents that hold them so many times."""
        tf = counts.astype(np.float64)
        return self.weight[words] * tf * (K1 + 1) / (tf + self.norm[docs])

    def best(self, queries, top, floor):
        """For some queries (word numbers) at a time: their numbers, places and scores of what may be
        among their best documents.

        ``floor`` has a score for each query that ``top`` documents are known to reach; it is raised.
        """
        for at in range(0, len(queries), QUERY_ROWS):
            batch = queries[at : at + QUERY_ROWS]
            words = self.row[np.concatenate(batch)]
            query = np.repeat(np.arange(len(batch)), [len(q) for q in batch])[words >= 0]
            words = words[words >= 0]
            dense = self.common_row[words] >= 0
            wanted = np.zeros((len(batch), len(self.near)), np.float32)
            wanted[query[dense], self.common_row[words[dense]]] = 1.0
            near = wanted @ self.near
            for low in range(0, len(batch), SCORE_ROWS):
                mine = slice(*np.searchsorted(query, [low, low + SCORE_ROWS]))
                q, places, scores = self._best(
                    near[low : low + SCORE_ROWS],
                    query[mine] - low,
                    words[mine],
                    top,
                    floor[at + low : at + min(low + SCORE_ROWS, len(batch))],
                )
                yield at + low + q, places, scores

    def _best(self, near, query, words, top, floor):
        """The same for a few queries. ``near`` has their common words' sums in single precision."""
        rows, n = near.shape
        size = max(1, min(BLOCK, n // (4 * top)))
        n_blocks = -(-n // size)
        scores = np.zeros((rows, n_blocks * size))
        scores[:, :n] = near
        blocks = scores.reshape(rows, n_blocks, size)
        common = self.common_row[words]
        rare = common < 0
        most = scores.max(1)
        # Rounding to 24 bits moves a sum of k terms by less than k parts in 2 ** 24 of it.
        slack = SLACK + (np.bincount(query[~rare], minlength=rows) + 2) * most * 2.0**-23
        bound = most + np.bincount(query[rare], self.largest[words[rare]], rows)
        rare &= (bound >= floor - slack)[query]
        self._add(scores, query[rare], words[rare])
        peaks = blocks.max(2)
        if n_blocks >= top:
            # So many blocks have a document of that score.
            reached = np.partition(peaks, n_blocks - top, 1)[:, n_blocks - top] - slack
            np.maximum(floor, reached, out=floor)
        limit = np.maximum(floor - slack, 1e-300)
        row, block = np.nonzero(peaks >= limit[:, None])
        cell, place = np.nonzero(blocks[row, block] >= limit[row, None])
        row, place = row[cell], block[cell] * size + place
        # What is left has its common words' sum put right.
        words, begin = words[common >= 0], np.searchsorted(query[common >= 0], np.arange(rows + 1))
        sizes = np.diff(begin)[row]
        words, doc = words[_ranges(begin[row], sizes)], np.repeat(place, sizes)
        gain = self._gain(words, doc, self.tf[self.common_row[words], doc])
        exact = np.bincount(np.repeat(np.arange(len(row)), sizes), gain, len(row))
        return row, place, exact + (scores[row, place] - near[row, place])

    def _add(self, scores, query, words):
        """Add to each query's row of ``scores`` what its rare words contribute."""
        width = scores.shape[1]
        sizes, start = self.sizes[words], self.start[words]
        for low, high in _strips(sizes):
            first, last = int(query[low]), int(query[high - 1]) + 1
            at = _ranges(start[low:high], sizes[low:high])
            slot = np.repeat((query[low:high] - first) * width, sizes[low:high])
            # Clipping leaves these places as they are, and spares a look at each.
            slot += self.docs.take(at, mode="clip")
            part = scores[first:last]
            part += np.bincount(slot, self.gain.take(at, mode="clip"), part.size).reshape(part.shape)


class Best:
    """The best documents of each query over the shards of a task."""

    def __init__(self, n_queries, top):
        self.top, self.floor = top, np.zeros(n_queries)
        self.held = [np.empty(0, kind) for kind in (np.int64, np.int64, bool, np.float64)]

    def add(self, shard, queries):
        found = [self.held]
        for query, docs, scores in shard.best(queries, self.top, self.floor):
            found.append(self._cut(query, shard.doc_ids[docs], shard.known[docs], np.round(scores, 9)))
        query, _, _, scores = self.held = self._cut(*map(np.concatenate, zip(*found)))
        last = np.arange(self.top - 1, len(query))
        full = last[query[last] == query[last - self.top + 1]]
        self.floor[query[full]] = np.maximum(self.floor[query[full]], scores[full])

    def _cut(self, query, doc_ids, known, scores):
        order = np.lexsort((doc_ids, ~known, -scores, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = (rank < self.top) & (scores[order] > 0)
        return [query[kept], *(column[order][kept] for column in (doc_ids, known, scores))]


def _ranges(first, sizes):
    """The places of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes)
    at += np.arange(len(at))
    return at


def _strips(sizes):
    """Bounds of runs of ranges with ``STRIP`` places, or up to one range more."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    low = 0
    for high in np.searchsorted(ends, np.arange(STRIP, total + STRIP, STRIP), "left").tolist():
        high = min(high + 1, len(ends))
        if high > low:
            yield low, high
            low = high


def _rows(batches):
    """Rows of binary columns as buffers over their batch."""
    for batch in batches:
        names = batch.schema.names
        rows = [{name: batch.column(name)[at].as_buffer() for name in names} for at in range(len(batch))]
        del batch
        while rows:
            yield rows.pop(0)


def _together(rows):
    """Lists of rows with about so many documents and postings as are searched as one.

    A list is given before the next row is read, so that rows that are done with can go.
    """
    held, docs, postings = [], [], []
    for row in rows:
        held.append(row)
        docs.append(len(row["lengths"]) // 8)
        postings.append(len(row["docs"]) // 2)
        del row
        if sum(docs) + max(docs) > JOINED_DOCS or sum(postings) + max(postings) > JOINED_POSTINGS:
            yield held
            held, docs, postings = [], [], []
    if held:
        yield held


def _forget():
    """Drop the words that this worker has remembered while it built the index."""
    worker_state("search_shards", dict)


def _count_task(block):
    def task(batches):
        _forget()
        vocabulary, total = block.value[1], None
        for row in _rows(batches):
            word, docs = document_counts(*places(row, vocabulary))
            total = np.zeros(len(vocabulary), "<i8") if total is None else total
            total[word] += docs
        if total is not None:
            for part, at in enumerate(range(0, len(total), COUNTED)):
                yield {"part": [part], "docs": [total[at : at + COUNTED].tobytes()]}

    return task


def _sum_counts(table):
    total = sum(np.frombuffer(docs.as_buffer(), "<i8") for docs in table.column("docs"))
    return pa.table({"part": table.column("part")[:1], "docs": pa.array([total.tobytes()], pa.binary())})


def _search_task(block, weights, mean_length, top):
    def task(batches):
        _forget()
        ids, vocabulary, queries = block.value
        best = None
        for rows in _together(_rows(batches)):
            best = best or Best(len(queries), top)
            shards = IndexShards(rows, vocabulary, weights.value, mean_length)
            rows.clear()
            best.add(shards, queries)
            del shards
        if best:
            query, doc_ids, known, scores = best.held
            yield {
                "query_id": [ids[number] for number in query.tolist()],
                "query_no": query,
                "doc_id": doc_ids,
                "known": known,
                "score": scores,
            }

    return task


def _query_task(batches):
    for batch in batches:
        yield {
            "doc_id": batch.column("doc_id"),
            "terms": [np.unique(words_of(data)).astype("<u8").tobytes() for data in utf8(batch.column("text"))],
        }


def query_blocks(queries, most=QUERY_WORDS):
    """Blocks of (ids, vocabulary, word numbers of each query), read one block at a time."""
    ids, words, size = [], [], 0

    def block():
        vocabulary = np.unique(np.concatenate(words))
        return ids, vocabulary, [np.searchsorted(vocabulary, w).astype("<i4") for w in words]

    hashed = in_arrow(queries.select("doc_id", "text"), _query_task, "doc_id bigint, terms binary")
    for row in session.cut(hashed, "queries").toLocalIterator():
        terms = np.frombuffer(row["terms"], "<u8")
        if ids and size + len(terms) > most:
            yield block()
            ids, words, size = [], [], 0
        ids.append(row["doc_id"])
        words.append(terms)
        size += len(terms)
    if ids:
        yield block()


@contextmanager
def _row_by_row(spark):
    """Read a row at a time, as a shard is a row of megabytes."""
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, "1")
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _dealt(index):
    """The index in fewer partitions, where there are many: a task sums up and ranks over its shards."""
    parts = index.rdd.getNumPartitions()
    return index.coalesce(max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-parts // TASK_PARTS)))


def search(index, queries, top=TOP):
    """Rows (query_id, rank, doc_id, score) of the best ``top`` documents of each query."""
    spark = index.sparkSession
    sizes = in_arrow(
        index.select("lengths"),
        lambda batches: (
            {"docs": [len(r["lengths"]) // 8], "words": [int(np.frombuffer(r["lengths"], "<i8").sum())]}
            for r in _rows(batches)
        ),
        "docs bigint, words bigint",
    ).agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = sizes[0] or 0, sizes[1] or 0
    parts = []
    for block in query_blocks(queries):
        held = spark.sparkContext.broadcast(block)
        with _row_by_row(spark):
            weights = spark.sparkContext.broadcast(_weights(index, held, n_docs))
            task = _search_task(held, weights, max(n_words, 1) / max(n_docs, 1), top)
            hits = in_arrow(_dealt(index), task, HITS)
            order = [F.desc("score"), F.desc("known"), "doc_id"]
            ranked = hits.withColumn(
                "rank", F.row_number().over(Window.partitionBy("query_no").orderBy(*order))
            )
            parts.append(session.cut(ranked.filter(F.col("rank") <= top), "hits"))
    if not parts:
        parts = [spark.createDataFrame([], f"{HITS}, rank int")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(
        "query_id", "rank", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "score"
    )


def _weights(index, block, n_docs):
    """The weight of each word of a block's vocabulary over all shards."""
    schema = "part bigint, docs binary"
    counted = in_arrow(_dealt(index).select("terms", "starts"), _count_task(block), schema)
    # One number per word of the block.
    sums = counted.groupBy("part").applyInArrow(_sum_counts, schema).collect()
    n = np.zeros(len(block.value[1]))
    for row in sums:
        docs = np.frombuffer(row["docs"], "<i8")
        n[row["part"] * COUNTED : row["part"] * COUNTED + len(docs)] = docs
    return np.where(n > 0, np.log1p((n_docs - n + 0.5) / (n + 0.5)), 0.0)


def op6_bm25_topk(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = search(build_index(docs), docs.filter(F.col("doc_id") % EVERY == 0))
    return found.withColumn("score", F.round("score", 6))
