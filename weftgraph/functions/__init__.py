"""Data preparation: relabelling and sampling."""
