"""DataFrame operators: histories, lookups, priors, audits, folds, sequences, scores and heads."""
