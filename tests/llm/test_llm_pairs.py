"""Similarity join, decontamination and search against brute force."""

import random

import fixtures_llm as X
import numpy as np

from cashtide.llm import components, decontaminate, signature_join, topk_search


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def jaccard(frame, **more):
    found = signature_join.similarity_components(frame, **more)
    return order(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect()))


def test_components_of_documents(spark, docs):
    assert jaccard(docs) == order(X.components(X.texts(docs)))


def test_components_of_awkward_rows(spark):
    frame = X.awkward(spark)
    assert jaccard(frame) == order(X.components(X.texts(frame)))
    assert jaccard(X.empty(spark)) == []


def family(rng, base, n, changes):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_components_near_the_threshold(spark):
    """Families whose members lie on both sides of the threshold, of many sizes."""
    rng, rows = random.Random(5), []
    for size in (4, 5, 6, 9, 14, 30, 60, 120, 400):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        rows += family(rng, base, 14, max(2, size // 18))
        rows += [" ".join(base[: int(size * f)]) for f in (0.7, 0.8, 0.85, 0.9)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    assert jaccard(frame) == order(X.components(list(enumerate(rows))))


def test_large_group_in_blocks(spark, monkeypatch):
    """A group far larger than a block, with strays that only some members reach."""
    monkeypatch.setattr(signature_join, "BLOCK_SETS", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = list(family(rng, base, 150, 3)) + list(family(rng, base, 60, 6))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    assert jaccard(frame) == order(X.components(list(enumerate(rows))))


def test_similar_sets_share_a_key():
    bands, rng = signature_join.Bands(), np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        kept = x[rng.random(len(x)) < rng.uniform(0.85, 1)]
        new = rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)
        y = np.unique(np.append(kept, new))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue

        def keys(s):
            own = bands.of_size(len(s))
            return {(b, k) for b in (own, own + 1) for k in bands.keys(s, b).tolist()}

        assert keys(x) & keys(y)


def test_keep_one_keeps_the_smallest_id(spark):
    frame = X.awkward(spark)
    kept = signature_join.keep_one(frame)
    assert kept.columns == frame.columns
    found = order((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect())
    # 1 stands for 2, 11 and the row without id; 6 for the other long text.
    assert found == order(
        [(1, "the q"), (3, ""), (4, ""), (5, " \t\n\x0b "), (6, "alpha"), (7, "xxxxx"), (8, "one"),
         (9, "123 4"), (10, "Ünïco"), (None, "")]
    )
    assert signature_join.keep_one(X.empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a int, b int")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "Short, item!"),
    (2, "Short, item!"),
    (3, None),
    (4, " ... "),
    (5, "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (6, "a a a a a a a a a a a a a a a"),
    (None, "no id at all"),
]


def test_contamination(spark, sf, docs):
    from cashtide.sources.tables import table

    columns = ["row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = table(spark, sf, "benchmark")
    pairs = [(r[0], r[1]) for r in items.select("item_id", "text").collect()]
    found = decontaminate.contamination(docs, items).select(*columns)
    expected = X.contamination(X.texts(docs), pairs)
    assert order(map(tuple, found.collect())) == order(expected)
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)
    # The same in several blocks of items.
    small = decontaminate.contamination(docs, items, block_words=200).select(*columns)
    assert order(map(tuple, small.collect())) == order(expected)


def test_contamination_of_awkward_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    words = ITEMS[0][1].split()
    rows = [
        (1, ITEMS[0][1].upper()), (2, "x short item y SHORT-ITEM z"), (3, None), (4, ""),
        (5, " ".join(words[:12])), (6, " ".join(words[1:]) + " fifteen " + ITEMS[0][1]),
        (7, "a " * 40), (8, "no id at all"), (None, "short"), (9, X.WALL), (10, X.LONG),
        (6, " ".join(words) + " filler" * 300),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontaminate.contamination(frame, items)
    named = [(None if i is None else i, t) for i, t in ITEMS]
    expected = X.contamination(rows, [("" if i is None else i, t) for i, t in named])
    columns = ["row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert order(map(tuple, found.select(*columns).collect())) == order(expected)
    kept = decontaminate.keep_clean(X.awkward(spark), items)
    assert kept.columns == X.awkward(spark).columns and kept.count() == 15
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.keep_clean(frame, none).count() == len(rows)
    assert decontaminate.contamination(X.empty(spark), items).count() == 0


def test_short_items_inside_others(spark):
    long = "x y a b c " + " ".join(f"w{i}" for i in range(12))
    texts = ["a b c", long, "z a b c d", "b c", "b c", "c", "a b c d e f"]
    pairs = list(enumerate(texts, 1))
    items = spark.createDataFrame(pairs, "item_id bigint, text string")
    rows = [(1, "a b c"), (2, long), (3, "q z a b c d q"), (4, "b c"), (5, "c"), (6, "y a b d")]
    rows += [(7, "a b c d e f"), (8, "b a b c c b c"), (9, "z a b c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    columns = ["row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = order(X.contamination(rows, pairs))
    for most in (decontaminate.BLOCK_WORDS, 5):
        scanned = decontaminate.scan(frame, items, ("doc_id",), block_words=most)
        # However many blocks, a task holds the automaton of one.
        assert scanned._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        found = decontaminate.contamination(frame, items, block_words=most).select(*columns)
        assert order(map(tuple, found.collect())) == expected
    one = decontaminate.contamination(frame, items.limit(2)).filter("row.doc_id = 1").collect()
    assert [(r["n_items"], r["items_sha256"]) for r in one] == [(1, X.sha("1"))]


def test_spans_are_removed(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    passage = ITEMS[0][1]
    rows = [(1, f"Before, {passage}. After" + " word" * 400), (2, f"x {passage} y"), (3, "clean")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = dict(map(tuple, decontaminate.remove_spans(frame, items).collect()))
    assert found == {1: "Before, . After" + " word" * 400, 2: "x  y", 3: "clean"}


def test_search(spark, docs):
    from pyspark.sql import functions as F

    queries = docs.filter(F.col("doc_id") % 10 == 0)
    found = topk_search.search(topk_search.build_index(docs), queries).collect()
    mine = order((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in found)
    wanted = order(X.bm25(X.texts(docs), X.texts(queries), 10))
    assert [r[:2] for r in mine] == [r[:2] for r in wanted]
    assert np.allclose([r[2] for r in mine], [r[2] for r in wanted], atol=2e-6)


def test_search_in_many_shards_and_blocks(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    queries = docs.filter(F.col("doc_id") % 10 == 0)
    one = topk_search.search(topk_search.build_index(docs), queries).collect()
    monkeypatch.setattr(topk_search, "SHARD_DOCS", 30)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "QUERY_WORDS", 500)
    many = topk_search.search(topk_search.build_index(docs), queries).collect()
    assert order(map(tuple, one)) == order(map(tuple, many))


def test_search_holds_few_bytes_for_a_posting(monkeypatch):
    """Indexing and searching a shard need little beside its postings, and searching forgets the
    words that indexing remembered."""
    import sys
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(topk_search, "STRIP", 1 << 14, raising=False)
    words = np.arange(20_000)
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{w}" for w in rng.choice(words, 250, replace=False)) for _ in range(2000)]
    texts = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    vocabulary = np.unique(topk_search.words_of(b" ".join(b"w%d" % w for w in words)))
    queries = [np.arange(at, at + 100) for at in range(0, len(vocabulary), 5000)]
    block = SimpleNamespace(value=(list(range(len(queries))), vocabulary, queries))
    weights = SimpleNamespace(value=np.ones(len(vocabulary)))

    def peak(task, batch):
        tracemalloc.start()
        try:
            (out,) = task(iter([batch]))
            return out, tracemalloc.get_traced_memory()[1] / (2000 * 250)
        finally:
            tracemalloc.stop()

    columns, indexing = peak(topk_search._index_task, texts)
    cells = [c if isinstance(c, pa.Array) else pa.array(c, pa.binary()) for c in columns.values()]
    shard = pa.RecordBatch.from_arrays(cells, names=list(columns))
    found, searching = peak(topk_search._search_task(block, weights, 250.0, 10), shard)
    assert len(found["doc_id"]) == 10 * len(queries)
    assert not isinstance(sys.modules["cashtide_worker_state"].held, topk_search.Memo)
    assert indexing < 46 and searching < 60


def shard_batches(texts, per_shard):
    """Index shards of ``per_shard`` documents, one in a batch."""
    import pyarrow as pa

    for at in range(0, len(texts), per_shard):
        some = texts[at : at + per_shard]
        rows = {"doc_id": range(at, at + len(some)), "text": some}
        (columns,) = topk_search._index_task(iter([pa.RecordBatch.from_pydict(rows)]))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def test_a_task_sums_up_and_ranks_over_its_shards(monkeypatch):
    """However many shards a task has, it gives one count for a word and ``top`` hits for a query."""
    from types import SimpleNamespace

    monkeypatch.setattr(topk_search, "JOINED_DOCS", 250, raising=False)
    monkeypatch.setattr(topk_search, "STRIP", 1 << 10)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(0, 90)) if w < 5000) for _ in range(700)]
    texts[650:] = texts[40:90]
    found = [np.unique(topk_search.words_of(t.encode())) for t in texts]
    vocabulary = np.unique(np.concatenate(found))
    queries = [np.searchsorted(vocabulary, words).astype("<i4") for words in found[::7]]
    block = SimpleNamespace(value=(list(range(0, 700, 7)), vocabulary, queries))
    counts = np.bincount(np.searchsorted(vocabulary, np.concatenate(found)))
    weights = SimpleNamespace(value=np.log1p((700 - counts + 0.5) / (counts + 0.5)))
    mean = np.mean([len(t.split()) for t in texts])
    shards = list(shard_batches(texts, 100))
    (counted,) = topk_search._count_task(block)(iter(shards))
    assert np.array_equal(np.frombuffer(counted["docs"][0], "<i8"), counts)
    (hits,) = topk_search._search_task(block, weights, mean, 10)(iter(shards))
    mine = list(zip(*(np.asarray(hits[k]).tolist() for k in ("query_id", "doc_id", "score"))))
    wanted = []
    for query_id, words in zip(block.value[0], queries):
        scores = np.zeros(len(texts))
        for doc, text in enumerate(texts):
            held = topk_search.words_of(text.encode())
            for word in words:
                tf = int((held == vocabulary[word]).sum())
                norm = 1.2 * (0.25 + 0.75 * len(held) / mean)
                scores[doc] += weights.value[word] * tf * 2.2 / (tf + norm)
        scores = np.round(scores, 9)
        best = np.lexsort((np.arange(len(texts)), -scores))[:10]
        wanted += [(query_id, doc, scores[doc]) for doc in best.tolist() if scores[doc] > 0]
    assert [r[:2] for r in mine] == [r[:2] for r in wanted]
    assert np.allclose([r[2] for r in mine], [r[2] for r in wanted], atol=2e-9)


def test_search_of_awkward_rows(spark):
    frame = X.awkward(spark)
    queries = frame.filter("doc_id is not null").select("doc_id", "text")
    found = topk_search.search(topk_search.build_index(frame), queries, top=4).collect()
    mine = order((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in found)
    wanted = order(X.bm25(X.texts(frame), X.texts(queries), 4))
    assert [r[:2] for r in mine] == [r[:2] for r in wanted]
    empty = X.empty(spark)
    index = topk_search.build_index(empty)
    assert topk_search.search(index, queries).count() == 0
    assert topk_search.search(index, empty).count() == 0
