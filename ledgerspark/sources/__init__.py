"""Scans: bill files, grids, configuration tables, targets and session logs."""
