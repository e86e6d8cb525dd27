"""Registered checks: each has a Spark form and, where SQL can say it, an oracle."""
