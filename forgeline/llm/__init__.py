"""Operators for training-data pipelines. Nothing else in forgeline imports this subpackage."""
