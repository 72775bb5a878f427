"""Registered queries, one module per family, each with its SQL counterpart."""

from importlib import import_module

_FAMILIES = (
    "grids", "rows", "states", "sources", "joins", "coverage", "contracts", "ranking",
    "scoring", "fits", "tiers", "streams", "flow", "exposure", "volatility",
)


def load_all():
    from strikeloom.plans import registry

    import os
    here = os.path.dirname(__file__)
    for family in _FAMILIES:
        if os.path.exists(os.path.join(here, f"{family}.py")):
            import_module(f"strikeloom.plans.{family}")
    return registry
