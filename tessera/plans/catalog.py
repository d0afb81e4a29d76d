"""All registered queries of the panel engine."""

from . import catalog_capacity, catalog_cross, catalog_data, catalog_evidence, catalog_ingest, catalog_signals, catalog_strategy, catalog_studies, catalog_trades, catalog_windows

_PARTS = (catalog_data, catalog_windows, catalog_cross, catalog_strategy, catalog_capacity, catalog_ingest, catalog_signals, catalog_trades, catalog_studies, catalog_evidence)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
