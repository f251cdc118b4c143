"""Venue, menu and review analytics expressed as Spark DataFrame operators."""
