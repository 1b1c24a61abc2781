"""Operators on tables of sequences: DataFrame in, DataFrame out, nothing sorted or collected."""
