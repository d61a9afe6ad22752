"""All named queries and their SQL."""

from __future__ import annotations

import textmill.plans.answer_queries
import textmill.plans.corpus_queries
import textmill.plans.evaluation_queries
import textmill.plans.policy_queries
import textmill.plans.retrieval_queries
import textmill.plans.state_queries
import textmill.plans.stream_queries
import textmill.plans.structure_queries
import textmill.plans.text_queries  # noqa: F401
from textmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
