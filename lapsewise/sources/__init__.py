"""Sources and sinks: raw marketplace files, driver test tables, fold files, models."""
