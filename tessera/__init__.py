"""Curation of labelled sample tables and evaluation of binary detectors, as Spark DataFrame functions."""
