"""The pipeline stage by stage against brute force, and what must not depend on it."""

import collections
import re
import subprocess
import sys
from pathlib import Path

import fixtures_llm as X
import pytest

import corpus_pipeline
from cashtide.llm import language_id, mixing
from cashtide.llm.common import documents

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, sf):
    held = [documents(spark, sf)]
    for _, stage in corpus_pipeline.STAGES:
        from cashtide import session

        held.append(session.cut(stage(spark, held[-1], sf), "test-stage"))
    return held


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_stages_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.schema == stages[0].schema


def test_language_stage(stages):
    learned = language_id.learn_held_out(stages[0])
    classifier = language_id.Classifier(learned)
    expected = []
    for r in stages[0].collect():
        language, score = classifier.predict((r["text"] or "").encode())
        if language != "und" and score >= language_id.MARGIN:
            expected.append(tuple(r))
    assert rows(stages[1]) == sorted(expected, key=str)
    assert stages[1].count() >= 0.98 * stages[0].count()


def test_duplicate_stage(stages):
    smallest = {i for i, _, c in X.components(X.texts(stages[1])) if i == c}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(smallest)


def test_decontamination_stage(spark, sf, stages):
    from cashtide.sources.tables import table

    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = {r[0] for r in X.contamination(X.texts(stages[2]), items) if not r[5]}
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(clean)


def test_mixing_stage(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    taken = collections.Counter(r["doc_id"] for r in stages[4].collect())
    assert sum(taken.values()) == pytest.approx(sum(copies.values()), abs=len(copies) * 0.1)
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"])) for r in stages[3].collect()}
    assert set(taken.values()) <= {1, 2}
    whole = sum(sizes.values())
    assert sum(sizes[i] * n for i, n in taken.items()) == pytest.approx(1.5 * whole, rel=0.02)


def test_token_stage(stages):
    found = stages[5].orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in stages[4].collect())
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


def test_awkward_rows_pass(spark, sf):
    for frame in (X.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"), X.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf)
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            frame.count()


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_the_rest_imports_without_this_package(tmp_path):
    """In a copy that lacks the subpackage and the pipeline, the entry still has its queries."""
    import shutil

    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_null_source_is_not_a_dash(spark):
    """Rows of one id and text in the sources "-" and null keep the copies of their own source."""
    text = "some words that are counted here"
    rows = [(1, text, "en", "-", 1), (1, text, "en", None, 1), (2, text * 2, "en", "a", 1)]
    frame = spark.createDataFrame(rows, X.SCHEMA)
    wanted = {(r["source"], r["doc_id"]): r["copies"] for r in mixing.mix(frame).collect()}
    taken = collections.Counter((r["source"], r["doc_id"]) for r in mixing.take_copies(frame).collect())
    assert taken == {k: n for k, n in wanted.items() if n}
    assert max(taken.values()) <= mixing.MOST


def test_survivors_do_not_depend_on_the_order_of_rows(spark):
    from pyspark.sql import functions as F

    from cashtide.llm import signature_join

    text = "one two three four five six seven"
    rows = [(1, text, lang, "a", n) for lang in ("fr", "de", "en") for n in (3, 2)]
    rows += [(2, text, "en", "a", 1), (3, "quite other words in this text here", "en", "a", 1)]
    frame = spark.createDataFrame(rows, X.SCHEMA).withColumn("more", F.create_map(F.lit("k"), "lang"))
    for keep in (signature_join.keep_one, mixing.take_copies):
        found = []
        for order in ("lang", F.desc("lang"), F.desc("n_chars")):
            kept = keep(frame.repartition(1).sortWithinPartitions(order))
            found.append(sorted((r["doc_id"], r["lang"], r["n_chars"]) for r in kept.collect()))
        assert found[0] == found[1] == found[2]
        assert {r[1:] for r in found[0] if r[0] == 1} <= {("de", 2)}
