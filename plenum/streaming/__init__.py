"""Continuous runs of the stateless checks over files that keep arriving."""
