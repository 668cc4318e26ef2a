"""fiscalflow: invoice (fiscal document) process analytics as Spark DataFrame jobs.

Layers:

* ``sources``    - readers (parquet, JDBC) and the mapping of the driver's
                   TPC-H-like tables onto the invoice model.
* ``functions``  - Column-expression helpers (CNPJ mask, month windows, money).
* ``operators``  - the analytics: fact, posting report, filters, KPIs, panels,
                   insert-if-absent, audits, exports.
* ``plans``      - the named query catalog and its DuckDB oracle SQL.
* ``streaming``  - incremental keyed ingest with Structured Streaming.
"""

from fiscalflow.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
