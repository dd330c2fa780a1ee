"""Webhook events: the same column logic for batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.functions import constants as K
from patchlens.functions.signing import is_authentic

STRICT_JSON = {"allowSingleQuotes": "false"}


def authentic_events(events: DataFrame, secret: str | None) -> DataFrame:
    """Events whose signature header matches the raw body."""
    return events.filter(is_authentic(secret, F.col("body"), F.col("signature")))


def project_events(events: DataFrame) -> DataFrame:
    """Replaces the body by action, repo, pr and head_sha; NULL when unreadable."""
    parsed = events.withColumn("_b", F.from_json("body", schemas.WEBHOOK_BODY, STRICT_JSON))
    return parsed.withColumns(
        {
            "action": F.col("_b.action"),
            "repo": F.col("_b.repository.full_name"),
            "pr": F.col("_b.pull_request.number"),
            "head_sha": F.col("_b.pull_request.head.sha"),
        }
    ).drop("_b", "body", "signature")


def is_reviewable(actions: Sequence[str] = K.PULL_REQUEST_ACTIONS) -> Column:
    """A pull-request event that opens, updates or reopens a change."""
    return (F.col("event_type") == K.PULL_REQUEST_EVENT) & F.col("action").isin(*actions)


def review_requests(events: DataFrame, secret: str | None) -> DataFrame:
    """Authentic, reviewable and complete events, projected. Stateless."""
    projected = project_events(authentic_events(events, secret)).filter(is_reviewable())
    return projected.filter(
        F.col("repo").isNotNull() & F.col("pr").isNotNull() & F.col("head_sha").isNotNull()
    )


def rejected_events(events: DataFrame, secret: str | None) -> DataFrame:
    """Events that cannot be handled, with a reason; one bad event stops nothing."""
    authentic = is_authentic(secret, F.col("body"), F.col("signature"))
    marked = project_events(events.withColumn("_ok", authentic))
    incomplete = F.col("repo").isNull() | F.col("pr").isNull() | F.col("head_sha").isNull()
    reason = (
        F.when(~F.col("_ok"), "unauthorized")
        .when((F.col("event_type") == K.PULL_REQUEST_EVENT) & F.col("action").isNull(), "unreadable body")
        .when(is_reviewable() & incomplete, "incomplete body")
    )
    return marked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_ok")
