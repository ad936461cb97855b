"""Performance-scoring analytics on Spark: boards, streaks, sequence and interval operators, robust fits, live scoring."""
