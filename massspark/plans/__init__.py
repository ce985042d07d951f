"""Named queries: queries holds the registry, reports adds those that go through files."""

from massspark.plans import queries, reports  # noqa: F401
