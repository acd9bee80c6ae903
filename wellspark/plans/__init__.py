"""Registered queries, by family."""

from importlib import import_module

FAMILIES = ["structure", "plates", "reports", "listings", "logs", "profiles", "cleaning", "quality", "sources", "streams", "hooks", "rawfiles"]


def load_all() -> None:
    import importlib.util

    for family in FAMILIES:
        if importlib.util.find_spec(f"wellspark.plans.{family}"):
            import_module(f"wellspark.plans.{family}")
