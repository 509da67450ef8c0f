"""Distributed operators: per-order pre-aggregation, exact prefix sums and
quantiles, the chronological split, statistical tests, classifier
evaluation, exact pairwise operators (kNN, silhouette), SMOTE and folds,
K-Means restarts."""
