"""Sources and sinks: transcript trees, side files, test-table adapters, exports."""
