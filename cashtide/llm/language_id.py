"""Language identification by compression.

Each language has a raw-content dictionary: slices of labelled texts, at most ``DICTIONARY``
bytes. Texts are lower-cased and everything but letters becomes a blank. A text is cut into pieces
of ``PIECE`` bytes, so that a long text does not become its own dictionary, each piece is
compressed with zstandard against every dictionary, and the language with the smallest sum over
the whole text wins. The score is the share by which the runner-up is larger; narrow margins
are rejected.

The dictionaries are the only thing learned, from a bounded sample: per language the
``SAMPLE`` labelled documents whose doc_id hashes lowest, their first ``SLICE`` characters.
With ``hold_out``, documents whose crc32(doc_id) leaves the given remainder are kept out.

Null text or text without letters is ``und`` with score 0 and rejected; so is every text when no
language could be learned. Of languages with equal sums the first by name wins, with score 0.
Repeated rows give repeated results; an empty table gives an empty result; null labels are not
learned; further columns are ignored.
"""

import re

import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.llm.common import documents, filter_in_arrow, in_arrow, utf8

DICTIONARY = 96 * 1024
SLICE = 256
SAMPLE = DICTIONARY // SLICE * 2
PIECE = 1024
LEVEL = 9
UNKNOWN = "und"
#: Scores below this are too narrow to decide.
MARGIN = 0.005
FOLDS, HELD_OUT = 4, 2

PREDICTED = "doc_id bigint, lang_pred string, score double, rejected boolean"


_OTHER = re.compile("[\\W\\d_]+")


def letters(text):
    """The lower-cased words of a text as UTF-8, one blank between them."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS


def has_letter(text):
    return F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False))


def slice_of(text, place):
    """``SLICE`` letters and blanks of a text without anything else, from a place set by a hash."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "))
    last = F.greatest(F.length(plain) - SLICE + 1, F.lit(1))
    return F.substring(plain, F.pmod(place, last) + 1, F.lit(SLICE))


def learn(labelled, sample=SAMPLE, size=DICTIONARY):
    """Dictionaries by language from rows (doc_id, text, lang).

    Of each language the ``sample`` texts with the lowest hashes give a slice each, from a place
    anywhere in the whole text; slices are strung together, lowest hash first, until ``size`` bytes
    are full. The hash limit that about twice as many texts stay below follows from a count, so
    few rows move whatever the number of rows and files. What reaches the driver is bounded by the
    number of languages, which is that of the label's values. Repeated rows count once.
    """
    known = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn(
        "hash", F.xxhash64("doc_id", "text")
    )
    # Of hashes, not of rows: a text that comes often has but one hash to stay below the limit.
    counts = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"))
    spread = F.col("hash") / 2.0**64 + 0.5
    near = known.join(F.broadcast(counts), "lang").filter(spread * F.col("texts") < 2 * sample)
    slices = near.groupBy("lang", "hash").agg(
        F.first(slice_of(F.col("text"), F.xxhash64("hash"))).alias("slice")
    )
    lowest = Window.partitionBy("lang").orderBy("hash")
    slices = slices.withColumn("rank", F.row_number().over(lowest)).filter(F.col("rank") <= sample)
    found = {}
    for row in slices.orderBy("lang", "rank").collect():
        held = found.setdefault(row["lang"], bytearray())
        data = letters(row["slice"]) + b" "
        if len(held) + len(data) <= size:
            held += data
    return {lang: bytes(held) for lang, held in found.items()}


class Classifier:
    def __init__(self, dictionaries, level=LEVEL):
        self.languages = sorted(dictionaries)
        self.compress = []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(
                dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=level)
            self.compress.append(
                zstandard.ZstdCompressor(
                    level=level, dict_data=content, write_checksum=False,
                    write_content_size=False, write_dict_id=False,
                ).compress
            )

    def sums(self, data):
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum([len(compress(p)) for p in pieces]) for compress in self.compress]

    def predict(self, data):
        """Language and score of the UTF-8 text."""
        words = letters(data.decode("utf-8", "replace")) if data else b""
        if not self.languages or not any(map(str.isalpha, words.decode())):
            return UNKNOWN, 0.0
        sums = self.sums(words)
        best = min(range(len(sums)), key=sums.__getitem__)
        others = sums[:best] + sums[best + 1 :]
        score = 1.0 - sums[best] / min(others) if others else 1.0
        return self.languages[best], score


def _predict_task(dictionaries, margin):
    def task(batches):
        classifier = Classifier(dictionaries.value)
        for batch in batches:
            found = [classifier.predict(data) for data in utf8(batch.column(1))]
            yield {
                "doc_id": batch.column(0),
                "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found],
                "rejected": [f[0] == UNKNOWN or f[1] < margin for f in found],
            }

    return task


def predict(docs, dictionaries, margin=MARGIN):
    """Per document: language, score, and whether the margin is too narrow."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return in_arrow(docs.select("doc_id", "text"), _predict_task(held, margin), PREDICTED)


def keep_decided(docs, dictionaries, margin=MARGIN):
    """The rows of ``docs`` whose language is not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        classifier = Classifier(held.value)

        def decided(data):
            language, score = classifier.predict(data)
            return language != UNKNOWN and score >= margin

        return decided

    return filter_in_arrow(docs, make)


def learn_held_out(docs):
    """Dictionaries from all folds but the held-out one."""
    return learn(docs.filter(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "text", "lang"))


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return predict(docs, learn_held_out(docs)).select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )
