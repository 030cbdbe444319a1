"""Column helpers and skew-safe running windows."""
