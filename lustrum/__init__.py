"""Cleaning and auditing untrusted text at table scale, as Spark columns and transforms."""
