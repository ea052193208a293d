"""Whole runs: one experiment, the grid of experiments, their comparison."""
