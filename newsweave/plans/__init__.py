"""All registered queries; importing the modules fills the registry."""

from newsweave.plans import catalog  # noqa: F401
from newsweave.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
