"""Token ids as length-delimited binary records with an offset index.

Documents are dealt by ranges of doc_id, so shard files in order hold them in ascending order
(nulls first; equal ids by the hash of their text). A shard file starts with ``HEADER``:
a mark and the width of an id in bytes. Each record is

    length of the body (u64) | masked CRC-32 of those 8 bytes (u32) | body | masked CRC-32 of it

and the body is one byte (1: has a doc_id), the doc_id (i64) and the ids, all little-endian.
The offset index is a Parquet table with one row per record: shard, offset, length.
Files are named at random by the task attempt that writes them and count only when the index
names them, so a lost or repeated task leaves no half-written shard behind.

Null text is an empty sequence: the end id alone. Repeated rows are written as often as they
come; an empty table gives an empty index; further columns are ignored.
"""

import json
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.bpe_count import VOCABULARY, byte_letters, vocabulary_path
from cashtide.llm.common import Memo, documents, in_arrow, utf8, worker_state

MARK = b"TOKREC1"
END_ID = 1
#: Chunks of text whose ids one Python worker remembers, and chunks that are signs alone.
REMEMBERED = 450_000
REMEMBERED_SIGNS = 10_000
#: ASCII signs that often stand behind a word.
SIGNS = ".,;:!?*#$%&|)"

INDEX = (
    "part int, file string, position bigint, doc_id bigint, byte_offset bigint, "
    "byte_length bigint, n_tokens bigint"
)
RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"


def masked_crc(data):
    """CRC-32 rotated and shifted, so that a checksum of stored checksums stays meaningful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body):
    length = struct.pack("<Q", len(body))
    return b"".join(
        (
            length,
            struct.pack("<I", masked_crc(length)),
            body,
            struct.pack("<I", masked_crc(body)),
        )
    )


def read_frame(stream):
    """The next body of a stream, ``None`` at its end; raises when a checksum is wrong."""
    head = stream.read(12)
    if not head:
        return None
    length, crc = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("record length is damaged")
    body = stream.read(length)
    if len(body) != length or masked_crc(body) != struct.unpack("<I", stream.read(4))[0]:
        raise ValueError("record body is damaged")
    return body


class Encoder:
    """Ids of a text by the tokenizers library.

    The vocabulary has no token across white space, so the library is asked once for each
    chunk between ASCII white space. Latin chunks without added tokens are cut into words
    by the file's own rule and only the words go to the library's model.
    """

    def __init__(self, path):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.width = 2 if len(spec["model"]["vocab"]) + len(spec["added_tokens"]) < 65536 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        pattern = next(
            p["pattern"]["Regex"]
            for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        self.words = regex.compile(pattern).findall
        self.special = re.compile("[^\\x00-\\u024f]|<").search
        self.letters = byte_letters()
        self.tokenize = self.library.model.tokenize
        self.of_signs = Memo(self.word, REMEMBERED_SIGNS)
        self.of_chunk = Memo(self.chunk, REMEMBERED)

    def chunk(self, data):
        text = data.decode("utf-8", "replace")
        if self.special(text):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        # Letters alone are one word by any rule, and so are the signs behind them.
        bare = text.rstrip(SIGNS)
        if bare.isalpha():
            signs = text[len(bare) :]
            return self.word(bare) + (self.of_signs[signs] if signs else b"")
        return b"".join(map(self.word, self.words(text)))

    def word(self, word):
        # Printable ASCII stands for itself.
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode()])
        return self.packed([t.id for t in self.tokenize(word)])

    def packed(self, ids):
        held = array(self.code, ids)
        if sys.byteorder == "big":
            held.byteswap()
        return held.tobytes()

    def encode(self, data):
        """The ids of a whole text as little-endian bytes."""
        return b"".join(map(self.of_chunk.__getitem__, (data or b"").split()))


def _encoder(vocabulary):
    return worker_state(f"encoder_{vocabulary}", lambda: Encoder(vocabulary_path(vocabulary)))


def _open(uri, how):
    """A stream in any file system that pyarrow knows by its URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if how == "rb":
        return system.open_input_stream(path, buffer_size=1 << 20)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, buffer_size=1 << 20)


def _write_task(folder, vocabulary, end_id):
    def task(batches):
        encoder = _encoder(vocabulary)
        part = TaskContext.get().partitionId()
        file, stream, offset, position = f"{uuid.uuid4().hex}.rec", None, 0, 0
        end = np.array([end_id], encoder.type).tobytes()
        for batch in batches:
            if batch.num_rows and stream is None:
                stream = _open(f"{folder}/records/{file}", "wb")
                stream.write(MARK + bytes([encoder.width]))
                offset = len(MARK) + 1
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                head = struct.pack("<Bq", doc_id is not None, doc_id or 0)
                ids = encoder.encode(data) + end
                record = frame(head + ids)
                stream.write(record)
                rows.append((doc_id, offset, len(record), len(ids) // encoder.width))
                offset += len(record)
            yield {
                "part": [part] * len(rows),
                "file": [file] * len(rows),
                "position": range(position, position + len(rows)),
                "doc_id": [r[0] for r in rows],
                "byte_offset": [r[1] for r in rows],
                "byte_length": [r[2] for r in rows],
                "n_tokens": [r[3] for r in rows],
            }
            position += len(rows)
        if stream is not None:
            stream.close()

    return task


def write_records(docs, folder, vocabulary=VOCABULARY, end_id=END_ID):
    """Encode ``docs`` (doc_id, text) into ``folder``; returns the offset index."""
    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    index = in_arrow(dealt, _write_task(folder, vocabulary, end_id), INDEX)
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def shards(index):
    """One row per shard file in order, with the ids in all shards before it."""
    sums = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )


def _read_task(folder):
    def task(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                start, rows = shard["start"], []
                stream = _open(f"{folder}/records/{shard['file']}", "rb")
                mark = stream.read(len(MARK) + 1)
                if mark[:-1] != MARK:
                    raise ValueError("not a record file")
                kind = np.dtype(f"<u{mark[-1]}")
                while (body := read_frame(stream)) is not None:
                    known, doc_id = struct.unpack_from("<Bq", body)
                    ids = np.frombuffer(body, kind, offset=9).astype("<u4")
                    crc = zlib.crc32(ids.tobytes())
                    rows.append((doc_id if known else None, start, len(ids), crc))
                    start += len(ids)
                stream.close()
                yield {
                    "doc_id": [r[0] for r in rows],
                    "start": [r[1] for r in rows],
                    "n_tokens": [r[2] for r in rows],
                    "ids_crc32": [r[3] for r in rows],
                    "shard": [shard["part"]] * len(rows),
                }

    return task


def read_records(index, folder):
    """What the files of an index hold: per record its place, length and checksum of ids."""
    files = session.cut(shards(index), "shards")
    spread = files.repartition(max(1, files.count()))
    return in_arrow(spread, _read_task(folder), RECORDS)


def encode_and_read_back(docs):
    folder = session.fresh_dir(docs.sparkSession, "token-records")
    return read_records(write_records(docs, folder), folder)


def op1_token_records(spark, sf_dir):
    return encode_and_read_back(documents(spark, sf_dir))
