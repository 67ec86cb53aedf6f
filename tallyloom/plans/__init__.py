"""Whole jobs: the analysis bundle, the evaluation run, and the registry of named queries."""
