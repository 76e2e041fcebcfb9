"""Compositions of operators: the dataset run and the registered queries."""
