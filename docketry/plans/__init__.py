"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ("cleaning", "text", "aggregates", "retrieval", "learning")


def load():
    """Import every family and return the filled registry."""
    for family in FAMILIES:
        import_module(f"docketry.plans.{family}")
    return import_module("docketry.plans.registry")
