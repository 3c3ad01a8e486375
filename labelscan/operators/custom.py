"""Custom rules written in Python, with errors as results of the row they concern (UDF-1)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.operators.rules import PRODUCT_COLUMNS, Rule

RESULT = "status string, severity string, message string"
NAMES = ["status", "severity", "message"]
STATUSES = (V.PASS, V.FAIL, V.MANUAL_REVIEW, V.NOT_APPLICABLE)


def _failure(error: Exception) -> tuple[str, str, str]:
    return V.FAIL, "CRITICAL", f"{V.RULE_FAILURE}{error}"


def _results(evaluate: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> list[tuple[str, str, str]]:
    """Results of the rows in order; raises if they are not one known status for each row."""
    found = evaluate(rows)
    if len(found) != len(rows):
        raise ValueError(f"{len(found)} results for {len(rows)} rows")
    wrong = ~found["status"].isin(STATUSES)
    if wrong.any():
        raise ValueError(f"no known status: {found['status'][wrong].iloc[0]}")
    return list(found[NAMES].itertuples(index=False, name=None))


def _halved(evaluate: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> list[tuple[str, str, str]]:
    """Results of the rows in order; rows that raise are found by halving."""
    try:
        return _results(evaluate, rows)
    except Exception as error:
        if len(rows) == 1:
            return [_failure(error)]
        half = len(rows) // 2
        return _halved(evaluate, rows.iloc[:half]) + _halved(evaluate, rows.iloc[half:])


def _kinds(rows: pd.DataFrame) -> pd.Series | None:
    """The number of each row's kind, equal rows being of one kind; null if the rows cannot be compared."""
    try:
        # floats by their bits: a rule may tell 0.0 from -0.0
        bits = {c: rows[c].to_numpy().view(f"i{rows[c].dtype.itemsize}") for c in rows if rows[c].dtype.kind == "f"}
        return rows.assign(**bits).groupby(list(rows.columns), dropna=False, sort=False).ngroup()
    except (TypeError, ValueError, AttributeError):
        return None


def _judge(evaluate: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> list[tuple[str, str, str]]:
    """Results of the rows in order; if some raise, equal rows are tried once, so halving costs what differs."""
    try:
        return _results(evaluate, rows)
    except Exception:
        kinds = _kinds(rows)
        if kinds is None:
            return _halved(evaluate, rows)
        found = _halved(evaluate, rows[~kinds.duplicated()].reset_index(drop=True))
        return [found[kind] for kind in kinds]


def guarded(evaluate: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Column:
    """struct<status,severity,message> of ``evaluate`` over the columns, one Arrow batch at a time.

    ``evaluate`` gets the rows as a frame and gives a frame of as many rows with status, severity and
    message. If it raises, the batch's distinct rows are halved until the ones that raise stand alone; each of
    those fails with the error's text, all others keep their results. A batch without errors costs one call.
    Equal rows of such a batch get one result: what ``evaluate`` gives for a row must follow from that row.
    """

    @F.pandas_udf(RESULT)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_judge(evaluate, rows.reset_index(drop=True)) if len(rows) else [], columns=NAMES)

    return run(F.struct(*columns))


def by_row(evaluate: Callable[[dict], tuple], severity: str = "HIGH") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A frame function of a function of one row that gives (status, message) or (status, message, severity).

    Each row's error is its own result, so nothing is evaluated twice.
    """

    def one(row: dict) -> tuple[str, str, str]:
        try:
            status, message, *own = evaluate(row)
            if status not in STATUSES:
                raise ValueError(f"no known status: {status}")
            return status, own[0] if own else severity, message
        except Exception as error:
            return _failure(error)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # missing values arrive as None, whatever the column's type
        records = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.DataFrame([one(r) for r in records], columns=NAMES, index=rows.index)

    return run


def python_rule(
    rule_id: str, name: str, evaluate: Callable, targets: list[str], by_batch: bool = False, severity: str = "HIGH", **more
) -> Rule:
    """A rule whose verdict a Python function gives, over the product fields ``targets``.

    The function sees one row as a dict of columns, or with ``by_batch`` a whole frame of them. A row on
    which it raises, or for which it gives no known status, is a FAIL of severity CRITICAL with the
    error's text; the job and the other rules of the row go on. What ends the Python process ends the task.
    """
    columns = [PRODUCT_COLUMNS.get(t, t) for t in targets]
    run = evaluate if by_batch else by_row(evaluate, severity)
    return Rule(rule_id, name, severity=severity, custom=lambda: guarded(run, columns), **more)
