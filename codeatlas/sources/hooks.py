"""A hook of a git repository that brings the graph up to date before each commit."""

from __future__ import annotations

import os
import stat
import subprocess
from pathlib import Path

BEGIN, END = "# codeatlas: begin", "# codeatlas: end"


def hook_path(repository: str) -> Path:
    """Where git looks for the hook, worktrees and a configured folder included."""
    out = subprocess.run(["git", "-C", repository, "rev-parse", "--git-path", "hooks/pre-commit"], capture_output=True, check=True, text=True).stdout.strip()
    return Path(repository, out)


def _without(text: str) -> str:
    """A hook's text without our lines."""
    before, begun, rest = text.partition(BEGIN + "\n")
    if not begun:
        return text
    return before + rest.partition(END + "\n")[2]


def install_hook(repository: str, command: str, stage: list[str]) -> Path:
    """Adds ``command``, and staging of the files it writes, to the repository's hook; what the hook has
    is kept, and our lines are there once however often this is called."""
    path = hook_path(repository)
    text = _without(path.read_text()) if path.exists() else "#!/bin/sh\n"
    quoted = " ".join("'" + s.replace("'", "'\\''") + "'" for s in stage)
    lines = [BEGIN, f"{command} || exit 1", *([f"git add -- {quoted}"] if stage else []), END]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text + ("" if text.endswith("\n") else "\n") + "\n".join(lines) + "\n")
    os.chmod(path, path.stat().st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return path


def uninstall_hook(repository: str) -> bool:
    """Takes our lines out, and removes a hook that has nothing else; whether there were any."""
    path = hook_path(repository)
    if not path.exists() or BEGIN not in (text := path.read_text()):
        return False
    left = _without(text)
    if left.strip() in ("", "#!/bin/sh"):
        path.unlink()
    else:
        path.write_text(left)
    return True
