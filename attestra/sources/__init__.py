"""Sources and sinks. Every read has an explicit schema; broken documents become rows, not errors."""
