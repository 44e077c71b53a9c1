"""Spark jobs for auditing labelled collections and evaluating classifiers."""
