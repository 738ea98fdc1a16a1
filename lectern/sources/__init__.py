"""Readers of the file formats that the jobs take."""
