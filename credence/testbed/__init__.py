"""Test-bed: the stored tables derived from the test data, the registered queries and their SQL checks."""
