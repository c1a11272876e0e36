"""Whole plans: the dashboard refresh and the registered queries."""
