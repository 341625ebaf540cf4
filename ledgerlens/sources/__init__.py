"""Sources and sinks: table loading, fixture views, CSV and report-export readers."""

from ledgerlens.sources.tables import read_table  # noqa: F401
