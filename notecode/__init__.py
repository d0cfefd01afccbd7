"""Multi-label note coding on Spark: every step is a function from DataFrame to DataFrame."""
