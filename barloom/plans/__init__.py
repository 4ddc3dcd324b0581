"""Whole analyses composed of operators: backtests, parameter search, validation."""
