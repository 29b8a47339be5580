"""Set-at-a-time knowledge-graph question answering on Spark."""
