"""Sources, sinks and the adapter onto the test tables."""
