"""Editorial workflow: commands folded over articles, with an audit trail.

Each command is allowed or refused by the state that the commands before it have left, so an article's commands are folded in
order. Rows are spread and sorted by article and number and pass through each task as a stream, so a task holds one article's
state and one batch, however many commands an article has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DRAFT, PENDING, PUBLISHED, UNPUBLISHED, ARCHIVED, REJECTED = "DRAFT", "PENDING_REVIEW", "PUBLISHED", "UNPUBLISHED", "ARCHIVED", "REJECTED"
AUDIT = "article long, seq long, command string, accepted boolean, code string, status string, version long, published_version long"
FRESH = (None, None, None, None)


def step(state: tuple, command: str) -> tuple[tuple, str]:
    """The next state and "" or the code of the refusal. State: article's status, number of versions, published version, pending version's status."""
    status, versions, published, draft = state
    if command == "create":
        return (state, "CONFLICT") if status else ((DRAFT, 1, None, DRAFT), "")
    if status is None:
        return state, "NOT_FOUND"
    follow = lambda new: status if published else new  # noqa: E731  a published article keeps its status while a revision moves
    moved = lambda new: ((follow(new), versions, published, new), "")
    # fixed values: the codes of refusals
    if command in ("submit", "withdraw") and draft is None:
        return state, "NO_EDITABLE_VERSION"
    if command in ("approve", "reject") and draft is None:
        return state, "NO_PENDING_VERSION"
    if command in ("withdraw", "approve", "reject") and draft != PENDING:
        return state, "NOT_PENDING_REVIEW"
    if command in ("revise", "edit_published", "unpublish") and status != PUBLISHED:
        return state, "NOT_PUBLISHED"
    if command in ("revise", "edit_published") and draft is not None:
        return state, "REVISION_IN_PROGRESS"
    if command == "submit":
        return (state, "ALREADY_SUBMITTED") if draft == PENDING else moved(PENDING)
    if command == "withdraw":
        return moved(DRAFT)
    if command == "reject":
        return moved(REJECTED)
    if command == "approve":
        return (PUBLISHED, versions, versions, None), ""
    if command == "revise":
        return (status, versions + 1, published, DRAFT), ""
    if command == "edit_published":
        return (PUBLISHED, versions + 1, versions + 1, None), ""
    if command == "unpublish":
        return (UNPUBLISHED, versions, published, draft), ""
    if command == "archive":
        return ((ARCHIVED, versions, published, draft), "") if status in (PUBLISHED, UNPUBLISHED) else (state, "NOT_ARCHIVABLE")
    if command == "delete":
        return (FRESH, "") if status == DRAFT and not published else (state, "ARTICLE_NOT_DELETABLE")
    return state, "UNKNOWN_COMMAND"


def fold(commands: DataFrame) -> DataFrame:
    """commands: article, seq, command. Returns the audit trail: each command, whether it was accepted, and the state after it.
    Null commands are refused as unknown; commands of equal number go by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        article, state = None, FRESH
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.article != article:
                    article, state = r.article, FRESH
                state, code = step(state, r.command)
                out.append((r.article, r.seq, r.command, not code, code or None, state[0], state[1], state[2]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in AUDIT.split(", ")]).astype({"version": "Int64", "published_version": "Int64"})

    rows = commands.filter("article IS NOT NULL").selectExpr("article", "seq", "command")
    return rows.repartition("article").sortWithinPartitions("article", "seq", "command").mapInPandas(run, AUDIT)
