"""Whole scoring flows made of the operators."""
