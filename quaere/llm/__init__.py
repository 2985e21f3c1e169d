"""Operators of a training-data pipeline.  Nothing else in ``quaere`` imports this subpackage."""
