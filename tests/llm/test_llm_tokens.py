"""Token counts and token records against the library over whole texts."""

import random
import zlib

import fixtures_llm as X
import numpy as np
import pytest
from tokenizers import Tokenizer

from cashtide import session
from cashtide.llm import bpe_count, token_records

PATH = bpe_count.vocabulary_path(bpe_count.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_whole_texts(spark, docs, library):
    for frame in (docs, X.awkward(spark)):
        expected = sorted(
            ((i or -1), len((t or "").encode()), len(ids(library, t))) for i, t in X.texts(frame)
        )
        rows = bpe_count.count_tokens(frame).collect()
        assert sorted((r[0] or -1, r[1], r[2]) for r in rows) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_counts_of_odd_characters(library):
    counter = bpe_count.Counter(PATH)
    samples = [
        "a\x0bb", "<|endoftext|>x", "it's <|startoftext|><|endoftext|> ok", "ΣΑΣ ΟΔΟΣ", "İ",
        "é ́x", "<|ENDOFTEXT|> <|endof", "\U0001f468‍\U0001f469", "Ɤ",
        "５ Ⅷ ²", "a\u0085b c",
    ]
    rng = random.Random(3)
    samples += ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(20)) for _ in range(300)]
    for text in samples:
        assert sum(map(counter.chunk, text.encode().split())) == len(ids(library, text)), text


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    ranks = {1 << 24 | 1: (1, 2), 2 << 24 | 1: (0, 3)}
    assert bpe_count.count_merged([1, 1, 1], ranks) == 1  # (1 1) 1 -> 2 1 -> 3
    assert bpe_count.count_merged([1, 1, 1, 1], ranks) == 2
    assert bpe_count.count_merged([], ranks) == 0


def test_records_hold_the_ids_of_whole_texts(spark, docs, library):
    for frame in (docs, X.awkward(spark)):
        rows = token_records.encode_and_read_back(frame).orderBy("start").collect()
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
        assert keys == sorted(keys)
        at = 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
        expected = []
        for i, t in X.texts(frame):
            own = np.array([*ids(library, t), 1], "<u4")
            expected.append((i or -1, len(own), zlib.crc32(own.tobytes())))
        found = [(r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows]
        assert sorted(found) == sorted(expected)


def test_index_gives_single_records(spark, docs, library):
    folder = session.fresh_dir(spark, "records-test")
    index = token_records.write_records(docs, folder).collect()
    text = dict(X.texts(docs))
    for row in random.Random(1).sample(index, 20):
        with open(f"{folder}/records/{row['file']}".removeprefix("file://"), "rb") as f:
            f.seek(row["byte_offset"])
            body = token_records.read_frame(f)
            assert f.tell() == row["byte_offset"] + row["byte_length"]
        found = np.frombuffer(body, "<u2", offset=9).tolist()
        assert found == [*ids(library, text[row["doc_id"]]), 1]


def test_damage_is_noticed():
    import io

    record = token_records.frame(b"some body")
    assert token_records.read_frame(io.BytesIO(record)) == b"some body"
    for at in (0, 14, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(record[:-6]))


def test_empty_table(spark):
    assert bpe_count.count_tokens(X.empty(spark)).count() == 0
    assert token_records.encode_and_read_back(X.empty(spark)).count() == 0
