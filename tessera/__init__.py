"""Spark jobs for trial, signal, regression and corpus data."""
