"""Queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import bagminhash, centroids, cgk, conversations, htmltext, licences, lines, lm, merkle, packing, pii, ranking, separators

_ALL = {
    "op8_licence_scan": (licences.op8_licence_scan, None),
    "op1_separator_scan": (separators.op1_separator_scan, None),
    "op10_log_frequency_bloom": (lm.op10_log_frequency_bloom, None),
    "op2_line_rules": (lines.op2_line_rules, lines.oracle()),
    "op3_nearest_centroid": (centroids.op3_nearest_centroid, None),
    "op4_crf_pii": (pii.op4_crf_pii, None),
    "op5_bradley_terry": (ranking.op5_bradley_terry, None),
    "op6_bagminhash": (bagminhash.op6_bagminhash, None),
    "op9_cgk_decontamination": (cgk.op9_cgk_decontamination, None),
    "op7_best_fit_packing": (packing.op7_best_fit_packing, None),
    "op11_postorder_manifest": (merkle.op11_postorder_manifest, merkle.oracle()),
    "op12_recurrent_html": (htmltext.op12_recurrent_html, None),
    "op13_conversation_repair": (conversations.op13_conversation_repair, conversations.oracle()),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
