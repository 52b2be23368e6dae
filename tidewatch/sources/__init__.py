"""Readers and sinks: panels, snapshots with manifests, ledgers."""
