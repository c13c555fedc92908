"""Hash columns, sizing formulas and estimators."""
