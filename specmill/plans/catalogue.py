"""All queries outside the llm subpackage."""

from . import answers, calibration, catalog, crawls, files, flows, hardfilter, matching, proposals, publish, retrieval, scalars, validators, values  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
