"""Whole runs: training sessions, analysis, the command line."""
