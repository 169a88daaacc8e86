"""Counterparty-risk preparation and governed retrieval as Spark DataFrame operators."""
