"""panelspark: causal features, labels and audits for time-series panels on Spark."""
