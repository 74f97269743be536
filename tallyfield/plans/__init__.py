"""Report bundles and the batch pipeline."""
