"""Folders for queries that read what they have written."""

from ..tables import new_folder

__all__ = ["new_folder"]
