"""Whole-dataset jobs."""
