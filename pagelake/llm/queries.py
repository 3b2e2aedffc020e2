"""The queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from . import bpe, embed_dedup, line_dedup, mixing, pii, quality_mil, secrets, simhash, topk, url_filter

QUERIES = {
    "op1_quality": quality_mil.query,
    "op2_bpe": bpe.query,
    "op3_topk": topk.query,
    "op4_simhash": simhash.query,
    "op5_pii": pii.query,
    "op6_url": url_filter.query,
    "op7_embed": embed_dedup.query,
    "op8_secrets": secrets.query,
    "op9_mix": mixing.query,
    "op10_lines": line_dedup.query,
}

SQL = {
    "op3_topk": topk.SQL,
    "op6_url": url_filter.SQL,
    "op7_embed": embed_dedup.SQL,
    "op9_mix": mixing.SQL,
    "op10_lines": line_dedup.SQL,
}
