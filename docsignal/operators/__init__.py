"""Relational operators and detectors over file and finding tables."""
