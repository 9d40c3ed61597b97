"""backtrail: strictly causal event-history features, label priors and score blending on Spark."""
