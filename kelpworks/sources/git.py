"""What a working copy's version control says about it."""

from __future__ import annotations

import subprocess


def git_facts(root: str) -> dict[str, str | bool] | None:
    """`branch, head, dirty` of a working copy; None if the folder is none or no git is at hand. Runs on the driver only."""

    def run(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    head = run("rev-parse", "--short", "HEAD")
    if head is None:
        return None
    return {"branch": run("rev-parse", "--abbrev-ref", "HEAD") or "", "head": head, "dirty": bool(run("status", "--porcelain"))}
