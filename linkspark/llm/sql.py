"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import centroids, licenses

ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op13_centroid_clustering": centroids.oracle()}
