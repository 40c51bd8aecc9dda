"""All named queries; importing the plan modules registers them."""

from __future__ import annotations

from kerbline.plans import corpus, evaluation, frames, ingest, labels, similarity, tracks  # noqa: F401
from kerbline.plans.registry import ORACLE, QUERIES

FLAGSHIP = "A2_similarity_vote"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
