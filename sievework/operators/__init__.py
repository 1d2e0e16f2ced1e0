"""Relational operators of the decision, evaluation and dataset pipelines."""
