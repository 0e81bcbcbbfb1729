"""Readers: files, containers, rules and stage artefacts."""
