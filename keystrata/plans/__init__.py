"""Registered queries; importing the package registers all of them."""

from . import cbom, documents, inventory, posture, reports, resolved  # noqa: F401
