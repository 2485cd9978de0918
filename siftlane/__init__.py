"""Blocklist and near-duplicate matching of media fingerprints on Spark DataFrames."""
