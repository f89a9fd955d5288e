"""Training-data operators: scans, deduplication, classifiers, mixing and tokenisation."""
