"""Whole plans: stages, state, sinks and the command line."""
