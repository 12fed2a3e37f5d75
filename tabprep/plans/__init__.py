"""Recipes: ordered preparation steps."""
