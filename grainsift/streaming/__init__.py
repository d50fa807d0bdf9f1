"""The row-wise operators and rules on Structured Streaming."""
