"""The queries of the training-data operators and of the pipeline, with SQL where SQL can state the result."""

from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import alignment, hilbert, infill, licenses, mixing, pages, pieces, quality, seedextend, simhash, syncmers, tokencount, urlrules


def queries() -> dict:
    return {
        "op1_separator_scan": tokencount.op1_query,
        "op2_license_join": licenses.op2_query,
        "op3_unigram_viterbi": pieces.op3_query,
        "op4_closed_syncmers": syncmers.op4_query,
        "op5_entropy_mix": mixing.op5_query,
        "op6_hilbert_shards": hilbert.op6_query,
        "op7_seed_extend": seedextend.op7_query,
        "op8_host_suffixes": pages.op8_query,
        "op9_simhash_deletion": simhash.op9_query,
        "op10_mcd_quality": quality.op10_query,
        "op11_infill_events": infill.op11_query,
        "op12_url_rules": urlrules.op12_query,
        "op13_token_alignment": alignment.op13_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "op2_license_join": licenses.OP2_SQL,
        "op5_entropy_mix": mixing.OP5_SQL,
        "op6_hilbert_shards": hilbert.OP6_SQL,
        "op7_seed_extend": seedextend.OP7_SQL,
        "op11_infill_events": infill.OP11_SQL,
        "op12_url_rules": urlrules.OP12_SQL,
    }
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
