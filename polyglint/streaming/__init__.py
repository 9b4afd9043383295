"""Change logs, streams, maintained views and replicated state."""
