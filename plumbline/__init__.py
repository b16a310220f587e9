"""Consistency analytics on Spark: votes, similarity, scores, diffs and streams."""
