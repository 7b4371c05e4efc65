"""From raw documents to token records: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with all columns of
``documents``; the last returns the records read back from its files.

1. Documents whose language is rejected go.
2. Of each group of near duplicates the document with the smallest id stays.
3. Documents contaminated by benchmark items go.
4. Documents are taken as often as the mix of sources asks: not at all, once or twice.
5. What is left is tokenised and written as binary records.
"""

from cashtide import session
from cashtide.llm import decontaminate, language_id, mixing, signature_join, token_records
from cashtide.llm.common import documents, small_batches
from cashtide.sources.tables import table


def identify_language(spark, docs, sf_dir):
    small_batches(spark)
    return language_id.keep_decided(docs, language_id.learn_held_out(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    small_batches(spark)
    return signature_join.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    return mixing.take_copies(docs)


def write_tokens(spark, docs, sf_dir):
    small_batches(spark)
    return token_records.encode_and_read_back(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: Compression, suffix automata and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        with session.scratch(spark):  # what a stage stores for itself goes with it
            docs = session.cut(stage(spark, docs, sf_dir), "stage", lasting=True)
    return docs
