"""Expressions as trees: parsing, checking, analysis and partial evaluation, all on the driver."""
