"""Relational operators: corpus statistics, blocking, features, decisions, metrics, folds, models."""
