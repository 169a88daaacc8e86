"""Operators for preparing training text, each over whole tables; nothing outside this folder imports it."""
