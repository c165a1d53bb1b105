"""Customer intelligence on Spark: identity, segments, value, attribution, audiences."""
