"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm import decontaminate, importance, license_scan, line_rules, media, mixing, negatives, neardup, piece_count, planes, spelling, toxicity, transcripts

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        media.op2_media_fingerprints,
        planes.op3_token_planes,
        neardup.op4_minhash_dedup,
        license_scan.op5_license_scan,
        transcripts.op6_transcripts,
        decontaminate.op7_decontaminate,
        importance.op8_importance,
        piece_count.op9_piece_counts,
        mixing.op10_source_mix,
        spelling.op11_spelling_variants,
        negatives.op12_hard_negatives,
        line_rules.op13_line_rules,
    )
}

ORACLE_SQL = {
    "op4_minhash_dedup": neardup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op10_source_mix": mixing.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op12_hard_negatives": negatives.ORACLE_SQL,
    "op13_line_rules": line_rules.ORACLE_SQL,
}
