"""Paths that must stay where they belong. Links and folders of the driver's file system are looked at on the driver."""

from __future__ import annotations

import os
import re

ARTIFACT_FOLDERS = ("artifacts", "images")


class PathError(ValueError):
    pass


def safe_output(path: str, folders: tuple[str, ...] = ARTIFACT_FOLDERS) -> bool:
    """Whether a relative path lies in one of the folders and never leaves it."""
    return bool(re.match(rf"({'|'.join(folders)})/.", path)) and "\\" not in path and ".." not in path.split("/")


def contained(root: str, path: str) -> str:
    """The real place of `path` under root, links followed; PathError where that is not within root."""
    top = os.path.realpath(root)
    found = os.path.realpath(os.path.join(top, path))
    if found != top and not found.startswith(top + os.sep):
        raise PathError(f"{path} is not within {root}")
    return found


def links_outside(root: str) -> list[tuple[str, str]]:
    """(path, target) of the links under root that lead out of it, in order."""
    found = []
    for folder, folders, files in os.walk(root):
        for name in (*folders, *files):
            path = os.path.join(folder, name)
            if os.path.islink(path):
                try:
                    contained(root, os.path.relpath(path, root))
                except PathError:
                    found.append((os.path.relpath(path, root), os.path.realpath(path)))
    return sorted(found)
