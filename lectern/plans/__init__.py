"""Whole jobs: from input files to output files, and from live segments to captions."""
