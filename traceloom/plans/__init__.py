"""Queries over the driver's tables; importing the package registers all of them."""

from . import activity, lines, queries, rules  # noqa: F401
