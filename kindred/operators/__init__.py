"""Relational and similarity operators: each takes DataFrames and returns one."""
