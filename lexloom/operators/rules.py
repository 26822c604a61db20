"""Rules in provisions: conditions, operators, time limits and their scores, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open a condition or exception, modal words, units of time.
CONDITION = r"(?:wenn|falls|sofern|soweit|lorsque|pour autant que|si|se|purché|where|provided|if)\s+(.+?)(?:,|\.|;)"
EXCEPTION = r"(?:ausser|ausgenommen|vorbehalten bleibt|sauf|excepté|hormis|salvo|eccetto|tranne|except|unless)\s+(.+?)(?:\.|;)"
LIMIT = r"(\d+)\s*(Tage?|Wochen?|Monate?|Jahre?|jours?|semaines?|mois|giorni|mesi|days|weeks|months|years)"
PROHIBIT = r"darf nicht|dürfen nicht|untersagt|verboten|ne doit pas|interdit|vietato|non deve|must not|shall not|prohibited"
OBLIGE = r"(?:^|\s)(muss|müssen|verpflichtet|doit|doivent|deve|devono|must|shall)(?:[\s.,;]|$)"
PERMIT = r"(?:^|\s)(darf|dürfen|kann|können|soll|peut|peuvent|può|possono|may|can)(?:[\s.,;]|$)"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def rule(text: Column) -> Column:
    """First condition, exception, time limit and the operator of a provision; prohibitions come first."""
    flat = F.regexp_replace(text, r"\s+", " ")
    operator = F.when(flat.rlike(PROHIBIT), "SHALL_NOT").when(flat.rlike(OBLIGE), "SHALL").when(flat.rlike(PERMIT), "MAY")
    return F.struct(
        _first(flat, CONDITION).alias("condition"), _first(flat, EXCEPTION).alias("exception"), operator.alias("operator"),
        _first(flat, LIMIT, 1).cast("int").alias("limit_value"), _first(flat, LIMIT, 2).alias("limit_unit"),
    )


def rule_score(operator: Column, condition: Column, exception: Column, limit: Column) -> Column:
    """0.5, more for an operator, condition, exception and time limit, 1 at most."""
    has = lambda c: c.isNotNull().cast("int")
    whole = (operator.isNotNull() & condition.isNotNull()).cast("int")
    return F.least(F.lit(1.0), 0.5 + 0.2 * has(operator) + 0.1 * has(condition) + 0.15 * has(exception) + 0.2 * has(limit) + 0.1 * whole)
