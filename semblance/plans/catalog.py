"""Collects every registered query."""

from __future__ import annotations

import importlib

from semblance.plans.registry import ORACLE, QUERIES

MODULES = ("profile_queries", "clean_queries", "prepare_queries", "sampling_queries", "report_queries", "utility_queries", "diffusion_queries", "source_queries", "distribution_queries")
for _m in MODULES:
    importlib.import_module(f"semblance.plans.{_m}")

__all__ = ["ORACLE", "QUERIES"]
