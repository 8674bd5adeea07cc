"""Logical plans: cubes, their axes, and predicates over them."""
