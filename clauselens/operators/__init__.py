"""Operators as functions of DataFrames and columns with arguments; `clauselens.plans.applied` applies them to the given tables."""
