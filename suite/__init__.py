"""Checked queries: each operator over the given tables, with its DuckDB counterpart."""

from suite.common import Suite


def all_suites() -> list[Suite]:
    from suite import basics, cleaning, profiles, talks

    return [basics.suite, profiles.suite, cleaning.suite, talks.suite]
