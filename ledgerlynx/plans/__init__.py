"""Queries over the driver's tables, by operator, with the same in DuckDB SQL."""

import importlib

from .bindings import ORACLES, QUERIES  # noqa: F401

for _name in ("v_validation", "j_patterns", "a_reports", "f_history", "r_rules", "g_network", "c_cases", "m_models", "s_functions", "t_streams", "i_sources"):
    importlib.import_module(f"{__name__}.{_name}")  # each registers its queries
