"""Carrying a plan out on a file system, with an audit log written before each step.

Moves come before deletes, deletes go to a quarantine folder, nothing is unlinked. An entry without a path is skipped as not
found. Options, off by default: deletes first, and numbered names where two files of one name meet.
"""

from __future__ import annotations

import json
import os
import shutil
import time

RETENTION_DAYS = 30
LAST_PLAN = ".last-plan.json"


def record_and_apply(plan: dict, root: str, **more) -> str:
    """Leave the plan in the root as its last one, then apply it from there."""
    path = os.path.join(root, LAST_PLAN)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plan, f, indent=2)
    return apply_plan(path, root, **more)


def apply_plan(plan: dict | str, root: str, dry_run: bool = False, retention_days: int = RETENTION_DAYS, deletes_first: bool = False, distinct_names: bool = False, stamp: str | None = None) -> str:
    """Returns the path of the audit log."""
    if isinstance(plan, str):
        with open(plan, encoding="utf-8") as f:
            plan = json.load(f)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    stamp = stamp or time.strftime("%Y%m%d-%H%M%S")
    quarantine, audit = os.path.join(root, ".quarantine", stamp), os.path.join(root, f".audit-{stamp}.jsonl")

    def log(**entry) -> None:
        with open(audit, "a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")

    def there(path: str | None) -> bool:
        return bool(path) and os.path.exists(path)

    def place(folder: str, name: str) -> str:
        out, n = os.path.join(folder, name), 1
        stem, ext = os.path.splitext(name)
        while distinct_names and os.path.exists(out):
            out, n = os.path.join(folder, f"{stem} ({n}){ext}"), n + 1
        return out

    def carry(src: str, dst: str) -> None:
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.move(src, dst)

    def move(e: dict) -> None:
        src = e.get("from")
        if not there(src):
            log(op="move", status="skip_not_found", src=src or "", to=e.get("to"))
            return
        dst = place(os.path.join(root, (e.get("to") or "").lstrip("/\\")), os.path.basename(src))
        log(op="move", status="dry_run" if dry_run else "moved", src=src, dst=dst)
        if not dry_run:
            carry(src, dst)

    def delete(e: dict) -> None:
        src, why = e.get("path"), e.get("reason")
        if not there(src):
            log(op="delete", status="skip_not_found", src=src or "", reason=why)
            return
        dst = place(quarantine, os.path.basename(src))
        log(op="delete", status="dry_run" if dry_run else "quarantined", src=src, qdst=dst, reason=why)
        if not dry_run:
            carry(src, dst)

    steps = [(move, plan.get("moves", [])), (delete, plan.get("deletes", []))]
    for act, entries in reversed(steps) if deletes_first else steps:
        for e in entries:
            act(e)
    log(op="meta", quarantine=quarantine, retention_days=retention_days)
    return audit
