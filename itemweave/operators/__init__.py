"""Operators: miners, support counting, preparation, layouts and experiment tables."""
