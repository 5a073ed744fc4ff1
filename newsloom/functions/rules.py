"""Ordered rules as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds; a null condition does not hold."""
    found = F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules))
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def all_matches(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)))


def missing(columns: Sequence[str]) -> Column:
    """Names of the columns that are null or blank."""
    return all_matches([(c, F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) for c in columns])


def any_word(text: Column, words: Sequence[str]) -> Column:
    """True if one of the words stands in a lower-case text between other characters than letters and digits."""
    return text.rlike(f"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)")


def keyword_gate(text: Column, discard: Sequence[tuple[str, Sequence[str]]], accept: Sequence[tuple[str, Sequence[str]]], otherwise: str = "discard:no_signal") -> Column:
    """``discard:<name>`` for the first discarding word list that hits a lower-case text, else ``accept:<name>``, else ``otherwise``."""
    rules = [(f"discard:{name}", any_word(text, words)) for name, words in discard] + [(f"accept:{name}", any_word(text, words)) for name, words in accept]
    return first_match(rules, otherwise)


#: Rule tables that a program has named, by name.
REGISTERED: dict[str, tuple[tuple[tuple[str, str], ...], str | None]] = {}


def rule_table(rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """``first_match`` of a table of (name, SQL condition over the row's columns)."""
    return first_match([(name, F.expr(condition)) for name, condition in rules], otherwise)


def code_table(rules: Sequence[tuple[str, str]]) -> Column:
    """``all_matches`` of a table of (name, SQL condition), joined by commas."""
    return F.array_join(all_matches([(name, F.expr(condition)) for name, condition in rules]), ",")


def register_rule(name: str, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> None:
    """Keep a rule table under a name, for ``registered``."""
    REGISTERED[name] = (tuple(rules), otherwise)


def registered(name: str) -> Column:
    return rule_table(*REGISTERED[name])


def case_sql(rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> str:
    """The table as a SQL expression for another engine."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules) + (f" ELSE '{otherwise}'" if otherwise is not None else "") + " END"


def codes_sql(rules: Sequence[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ")"
