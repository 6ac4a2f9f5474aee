"""Versioned wide-column cells on Spark: a log of puts and deletes, and everything that is derived from it."""
