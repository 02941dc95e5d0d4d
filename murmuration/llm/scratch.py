"""Intermediate tables of the operators: those of the library, under the names that this subpackage uses."""

from ..functions.tables import SETTING, clear, folder, mark, new_path, stage

__all__ = ["SETTING", "clear", "folder", "mark", "new_path", "stage"]
