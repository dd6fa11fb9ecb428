"""Queries over the driver tables, each with its SQL oracle."""

from . import curate, evaluate, grids, ingest, knowledge, retrieval, stored, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
