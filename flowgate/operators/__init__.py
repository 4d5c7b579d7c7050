"""Table operators: profiling, duplicates, sampling, splitting, preprocessing, metrics, audits, robustness."""
