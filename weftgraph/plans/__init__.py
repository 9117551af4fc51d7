"""Join orders, plan objects, and physical strategies."""
