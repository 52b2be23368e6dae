"""Whole evaluations, and the registered queries with their SQL."""
