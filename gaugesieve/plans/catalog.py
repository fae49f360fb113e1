"""All checks in one place."""

from __future__ import annotations

import importlib

FAMILIES = ("checks_flags", "checks_audit", "checks_features", "checks_classes", "checks_evaluation", "checks_models")


def _families():
    return [importlib.import_module(f"gaugesieve.plans.{name}").checks for name in FAMILIES]


def queries() -> dict:
    return {name: build for family in _families() for name, build in family.builders.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in _families() for name, text in family.sql.items()}


def flagship(spark, sf_dir: str):
    from gaugesieve.plans.checks_models import diagnostics
    return diagnostics(spark, sf_dir)
