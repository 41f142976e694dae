"""Operators of a training-data pipeline. Nothing else in marlstone imports this subpackage."""
