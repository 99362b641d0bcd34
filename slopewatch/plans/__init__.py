"""Queries made of the operators, each with the SQL it must agree with."""
