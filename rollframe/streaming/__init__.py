"""Streams of finished samples: intake, freshness rules and running metrics."""
