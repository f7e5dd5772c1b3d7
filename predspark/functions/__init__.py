"""The functions of the expression language: signatures, numbers, durations, patterns and host functions."""
