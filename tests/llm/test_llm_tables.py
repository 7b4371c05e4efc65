"""Line dedup by sorted runs, the filter audit and centroid clustering."""

import collections
import hashlib
import itertools
import math

import fixtures_llm as X
import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm import filter_audit, line_runs, vector_clusters

STRIPPED = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept_lines(texts, least):
    """Per text: lines, lines dropped and the text that is left."""
    split = [(t or "").split("\n") for t in texts]
    keyed = [[lowered(s.strip(STRIPPED)) for s in lines] for lines in split]
    held = collections.Counter(k for keys in keyed for k in set(keys) if k)
    out = []
    for lines, keys in zip(split, keyed, strict=True):
        kept = [s for s, k in zip(lines, keys, strict=True) if not k or held[k] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [
    "Terms apply\nfirst text\n  terms APPLY\t",
    "\n\nterms apply\n\n",
    "ÉTÉ\nTerms apply\r\nété",
    "été\x0b\n\x0c\nÉTÉ",
    "terms apply",
    None,
    "",
    " \t",
    "one\ntwo\nthree\n" * 3000,
    "w" * 300_000,
    "\n" * 5000,
    "no-break \nno-break",
]


@pytest.fixture(scope="module")
def lined(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(LINES)]
    rows += [(4, "terms apply", "en", "a", 0), (None, "one", "de", None, 0), (None, None, None, None, 0)]
    frame = spark.createDataFrame(rows, X.SCHEMA)
    return frame.withColumns({name: F.lit(i) for i, name in enumerate(X.CLASHING)})


def got_lines(frame):
    rows = frame.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("least", "batches", "fanout"), [(1, 3, 2), (2, 5, 2), (3, 2, 3), (100, 2, 2)])
def test_lines_against_brute_force(lined, least, batches, fanout):
    held = [(r["doc_id"], r["text"]) for r in lined.collect()]
    expected = [(i, *k) for (i, _), k in zip(held, kept_lines([t for _, t in held], least), strict=True)]
    found = line_runs.dedup_lines(lined, least, batches, fanout)
    assert got_lines(found) == sorted(expected, key=str)
    assert found.select("row.*").columns == lined.columns


def test_lines_of_awkward_and_empty_tables(spark):
    frame = X.awkward(spark)
    held = [(r["doc_id"], r["text"]) for r in frame.collect()]
    expected = [(i, *k) for (i, _), k in zip(held, kept_lines([t for _, t in held], 3), strict=True)]
    assert got_lines(line_runs.dedup_lines(frame, 3, 2)) == sorted(expected, key=str)
    assert line_runs.dedup_lines(X.empty(spark)).count() == 0


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_lines_of_whole_documents(docs, fanout):
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = [(i, *k) for (i, _), k in zip(held, kept_lines([t for _, t in held], 2), strict=True)]
    found = line_runs.dedup_lines(docs, 2, 4, fanout)
    assert got_lines(found) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 100


def keyed(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return line_runs.line_keys(frame)


def test_runs_survive_replays_writers_and_sessions(spark):
    folder = session.fresh_dir(spark, "test-runs")
    store = line_runs.LineRuns(spark, folder, least=2, buckets=3, fanout=2)
    batches = [["a\nb", "c"], ["a", "d"], ["b\ne", "a"], ["e", "f"], ["g", "g"]]
    stale = line_runs.LineRuns(spark, folder, least=2, buckets=3, fanout=2)
    counts, expected = collections.Counter(), []
    for number, texts in enumerate(batches):
        store.add(keyed(spark, texts), number)
        store.add(keyed(spark, texts), number)  # a replay adds nothing
        counts.update(k for t in texts for k in set(t.split("\n")))
        expected.append({k for k, n in counts.items() if n >= 2})
        names = {tuple(r) for r in store.found().collect()}
        wanted = keyed(spark, sorted(expected[-1])).select(F.inline("keys")).collect()
        assert names == {tuple(r) for r in wanted}
        if number == 2:  # another process goes on from the manifest
            store.close()
            store = line_runs.LineRuns(spark, folder)
            assert (store.held["least"], store.held["buckets"], store.held["batch"]) == (2, 3, 2)
    levels = collections.Counter(run["level"] for run in store.held["runs"])
    assert max(levels) == 2 and max(levels.values()) < 2  # 5 runs: one of level 0, one of level 2
    with pytest.raises(Exception, match="(?i)exist"):
        stale.add(keyed(spark, ["z"]), 0)
    store.close()
    stale.close()


def test_found_keys_meet_no_later_run_and_runs_are_not_moved(spark):
    folder = session.fresh_dir(spark, "test-runs")
    store = line_runs.LineRuns(spark, folder, least=1, buckets=3, fanout=5)
    store.add(keyed(spark, ["a\nb", "a"]), 0)
    store.add(keyed(spark, ["a", "c"]), 1)
    second = spark.read.parquet(store.held["runs"][1]["path"])
    assert second.count() == 1  # only "c" is new
    with store._aligned():
        run = store._read(store.held["runs"][0])
        other = store._read(store.held["runs"][1])
        plan = run.join(other.hint("merge"), line_runs.KEY, "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    store.close()


# -- filter audit --------------------------------------------------------------------------------


def brute_masks(docs, labels):
    least = {}
    for r in docs:
        if r["doc_id"] is not None:
            text = r["text"] or ""
            least[text] = min(least.get(text, math.inf), r["doc_id"])
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    out = []
    for r in docs:
        text, i = r["text"] or "", r["doc_id"]
        words = text.encode().split()
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        labelled = i is not None
        failed = {k for k, v in fails.items() if v}
        out.append((r["lang"] or "", failed, labelled and i in good, labelled and i in toxic))
    return out


def brute_audit(masks):
    parts = sorted({m[0] for m in masks})
    rows, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in parts:
            held = [m for m in masks if m[0] == part]
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [m for m in held if letter in m[1] and not m[1] & before]
                shapley[part, letter] += len(removed)
                rows[part, "".join(order), step] = [
                    sum(not m[1] & (before | {letter}) for m in held),
                    len(removed),
                    sum(letter in m[1] and bool(m[1] & before) for m in held),
                    sum(m[1] == {letter} for m in held),
                    sum(m[2] for m in removed),
                    sum(m[3] for m in removed),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def audited(frame):
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {
        (r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in frame.collect()
    }


@pytest.mark.parametrize("cells", [None, 1 << 16])
def test_audit_against_brute_force(spark, sf, docs, cells):
    from cashtide.sources.tables import table

    labels = table(spark, sf, "labels")
    expected = brute_audit(brute_masks(docs.collect(), labels.collect()))
    assert audited(filter_audit.audit(docs, labels, cells)) == expected


def test_audit_of_awkward_rows(spark):
    frame = X.awkward(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 1, 1), (99, 1, 1), (11, None, 1)],
        "doc_id bigint, quality int, toxic int",
    ).withColumn("text", F.lit("x"))
    expected = brute_audit(brute_masks(frame.collect(), labels.collect()))
    assert audited(filter_audit.audit(frame, labels)) == expected
    assert filter_audit.audit(X.empty(spark), labels).count() == 0
    assert audited(filter_audit.audit(frame, labels.limit(0))) == brute_audit(
        brute_masks(frame.collect(), [])
    )


def test_sketch_clears_unique_texts_and_no_repeat(spark):
    texts = [f"text {i % 3000}" for i in range(5000)]  # 2,000 texts twice, 1,000 once
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = session.cut(filter_audit.judged(frame.withColumn("lang", F.lit("en"))), "test-judged")
    cells = 1 << 17  # two blocks
    bits = filter_audit.crowded_cells(rows, cells)
    digests = {t: hashlib.sha256(t.encode()).digest() for t in set(texts)}
    at = {t: filter_audit.touched([d], cells)[0] for t, d in digests.items()}
    counts = collections.Counter(c for t in texts for c in at[t])
    full = {c for c, n in counts.items() if n > 1}
    assert {int(c) for c in np.flatnonzero(np.unpackbits(bits))} == {int(c) for c in full}
    marked = filter_audit.with_repeats(rows, cells)
    assert marked.filter("mask >= 16").count() == 2000
    assert sum(all(c in full for c in at[t]) for t in set(texts)) < 2100  # nearly all others are cleared


# -- centroid clustering -------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    held = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [math.floor(64 * x) for x in v]))
    seeds = sorted(
        (hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in held if i is not None
    )[:k]
    centroids = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in held:
            groups[nearest(v)[1]].append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(column) // len(vs) for column in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in held]
    inertia = collections.Counter()
    for _, n, d in found:
        inertia[n] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), names[n]) for i, n, d in found), key=str)


def clustered(frame, **more):
    found = vector_clusters.with_inertia(*vector_clusters.cluster(frame, **more))
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


KIND = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_against_brute_force(spark, sf, bits):
    from cashtide.sources.tables import table

    frame = table(spark, sf, "embeddings").limit(300)
    frame = session.cut(frame.withColumns({c: F.lit(1) for c in ("r", "v", "cluster")}), "test-vectors")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert clustered(frame, bits=bits) == brute_clusters(rows)


def test_clusters_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    same = [0.5] * 64
    rows = [(i, rng.integers(-3, 3, 64).astype(float).tolist()) for i in range(40)]
    rows += [(100 + i, same) for i in range(60)] + [(100, same), (None, same), (None, None)]
    rows += [(7, [0.25] * 63), (8, [0.25] * 65), (9, [None] + same[1:]), (10, [math.nan] + same[1:])]
    rows += [(11, [math.inf] + same[1:]), (12, [-1e6] + same[1:]), (13, [])]
    frame = spark.createDataFrame(rows, KIND)
    assert clustered(frame) == brute_clusters(rows)
    few = spark.createDataFrame(rows[:5] + rows[-3:], KIND)
    assert clustered(few) == brute_clusters(rows[:5] + rows[-3:])
    assert clustered(spark.createDataFrame([], KIND)) == []
    assert clustered(spark.createDataFrame([(None, same)], KIND)) == []


def test_intervals_hold_the_distances():
    """No centroid that may be nearest is ever left out, whatever the bits."""
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 8, (400, 64)) * rng.integers(1, 4, 64)).astype(np.int64)
    centroids = v[:16].copy()
    centroids[3] = centroids[5]
    true = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    for bits in (1, 2, 4, 6):
        grid = vector_clusters.Grid(v[:50], v.min(0), v.max(0), bits)
        codes = grid.codes(v)
        middle, half = grid.lookup(codes)
        assert (np.abs(v - middle) <= half).all()
        left = vector_clusters.left_over(codes, grid, centroids)
        assert all(left[i] >> int(c) & 1 for i in range(len(v)) for c in np.flatnonzero(true[i] == true[i].min()))
    assert (np.array([bin(x).count("1") for x in left]) < 3).mean() > 0.5
