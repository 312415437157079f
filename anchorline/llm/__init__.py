"""Operators for building large text training sets, each a set of Spark jobs."""
