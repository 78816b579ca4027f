"""Imports every query module so the registry is complete."""

from closebook.plans import registry

_MODULES = [
    "closebook.plans.q_slice",
    "closebook.plans.q_scalars",
    "closebook.plans.q_aggs",
    "closebook.plans.q_rules",
    "closebook.plans.q_sources",
    "closebook.plans.q_lookups",
    "closebook.plans.q_domain",
    "closebook.plans.q_verdicts",
    "closebook.plans.q_acceptance",
    "closebook.plans.q_contracts",
    "closebook.plans.q_ladders",
    "closebook.plans.q_worksheets",
]


def load() -> registry:
    import importlib

    for m in _MODULES:
        importlib.import_module(m)
    return registry
