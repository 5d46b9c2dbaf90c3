"""Operators for preparing training data, their registered queries, and the stages of the corpus pipeline."""
