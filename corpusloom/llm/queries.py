"""The contract queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, bpe, fingerprint, jaccard, lines, merkle, packing, quality, scoring, secrets, sharding, substrings, warc

QUERIES = {
    "op3_chosen_path_join": jaccard.op3_chosen_path_join,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op5_kd_shards": sharding.op5_kd_shards,
    "op10_warc": warc.op10_warc,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op4_quality_rules": quality.op4_quality_rules,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op11_merkle": merkle.op11_merkle,
    "op12_ngram_scores": scoring.op12_ngram_scores,
    "op13_filter_audit": audit.op13_filter_audit,
}

ORACLES = {
    "op10_warc": warc.ORACLE,
    "op4_quality_rules": quality.oracle(),
    "op11_merkle": merkle.oracle(),
    "op13_filter_audit": audit.ORACLE,
}
