"""Scale helpers and the driver's query catalogue."""
