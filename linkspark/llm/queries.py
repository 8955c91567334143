"""The registered query of each operator, and the SQL of those SQL can express."""

from __future__ import annotations

from . import centroids, importance, language, licenses, mixing, neardup, neighbours, passages, periodic, pieces, quality, secrets, tokens
from .sql import ORACLE_SQL

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op4_quality_classifier": importance.op4_quality_classifier,
    "op9_token_counts": tokens.op9_token_counts,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_id": language.op6_language_id,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
    "op10_near_dedup": neardup.op10_near_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_repeated_passages": passages.op12_repeated_passages,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
