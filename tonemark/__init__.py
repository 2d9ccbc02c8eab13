"""Spark jobs for evaluating classifiers on grouped, doubly labelled records."""
