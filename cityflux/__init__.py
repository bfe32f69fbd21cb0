"""Ride-demand analytics on Spark: trip tables in, checked feature tables out."""
