"""File-driven jobs as Structured Streaming queries over the batch operators."""
