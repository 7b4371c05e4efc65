"""The queries of this package, and their SQL where it can express them."""

from cashtide.llm import (
    bpe_count,
    decontaminate,
    filter_audit,
    language_id,
    line_runs,
    mixing,
    oracles,
    pii,
    secret_ledger,
    signature_join,
    token_records,
    topk_search,
    url_trust,
    vector_clusters,
)

QUERIES = {
    f.__name__: f
    for f in (
        token_records.op1_token_records,
        url_trust.op2_url_trust,
        bpe_count.op3_token_counts,
        signature_join.op4_jaccard_components,
        decontaminate.op5_benchmark_overlap,
        topk_search.op6_bm25_topk,
        mixing.op7_source_mixing,
        pii.op8_pii_spans,
        language_id.op9_language_id,
        secret_ledger.op10_secret_ledger,
        line_runs.op11_line_dedup,
        filter_audit.op12_filter_audit,
        vector_clusters.op13_vector_clusters,
    )
}

ORACLE = oracles.ORACLE
