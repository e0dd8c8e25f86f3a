"""nightjar — security telemetry analytics on Spark.

Modules:

* ``nightjar.sources``   — file/stream readers (syslog, CSV/JSON uploads, JSON logs) and table scans
* ``nightjar.functions`` — scalar Column functions (syslog parsing, trim, ISO time, ranks, ids)
* ``nightjar.operators`` — detection rules, analytics, listing/hunting, change application, SLO queries
* ``nightjar.sinks``     — landing, alerts/mappings, realtime feed, CSV/JSON export, versioned snapshots
* ``nightjar.streaming`` — ingest stream, live aggregates, stateful alerting
* ``nightjar.plans``     — adapter views over the test tables, registered queries + oracle SQL, batch jobs

Every operator is a lazy ``DataFrame -> DataFrame`` function over domain tables
(see ``nightjar.schemas.ENTITY_SCHEMAS``); ``as_of`` is always a parameter.
"""

__version__ = "0.1.0"
