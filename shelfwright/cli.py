"""Command line: scan a folder, write its documents, apply a plan; and the chat commands of an interactive front end."""

from __future__ import annotations

import argparse
import json
import re
import time
from dataclasses import dataclass


@dataclass
class Settings:
    endpoint: str = ""
    model: str = ""
    api_key: str = ""
    rate: float = 0.0
    dry_run: bool = True


COMMANDS = {
    "rate": r"/rate\s+(\d*\.?\d+)",
    "endpoint": r"/endpoint\s+(\S+)",
    "model": r"/model\s+(.+)",
    "apply": r"/apply",
    "dryrun": r"/dryrun\s+(on|off)",
    "help": r"/help",
    "organize": r"organize\s+(?:directory\s+)?(.+)",
}


def command(line: str, settings: Settings) -> tuple[str, str | None]:
    """(name, argument) of a line typed in; settings are changed in place. Unknown lines are ("unknown", line)."""
    line = line.strip()
    for name, pattern in COMMANDS.items():
        m = re.fullmatch(pattern, line, re.I)
        if not m:
            continue
        arg = m.group(1).strip() if m.groups() else None
        if name == "rate":
            settings.rate = float(arg)
        elif name == "dryrun":
            settings.dry_run = arg.lower() == "on"
        elif name in ("endpoint", "model"):
            setattr(settings, name, arg)
        elif name == "organize":
            arg = arg.strip('"')
        return name, arg
    return "unknown", line


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shelfwright", description=__doc__)
    p.add_argument("--path", help="folder to scan")
    p.add_argument("--out", default="out", help="folder for graph.json, summaries.json and plan.json")
    p.add_argument("--endpoint"), p.add_argument("--model"), p.add_argument("--api-key")
    p.add_argument("--rate", type=float, default=0.0, help="storage price of a gigabyte and month")
    p.add_argument("--apply", metavar="PLAN", help="carry out this plan on --path instead of scanning")
    p.add_argument("--for-real", action="store_true", help="with --apply: move files, not only log")
    a = p.parse_args(argv)
    if not a.path:
        p.error("--path is missing")
    if a.apply:
        from shelfwright.plans.apply import apply_plan

        print("[OK] audit log:", apply_plan(a.apply, a.path, dry_run=not a.for_real))
        return 0

    from shelfwright.operators.categorize import http_chat
    from shelfwright.plans.pipeline import organize, write_documents
    from shelfwright.session import local_session
    from shelfwright.sources.scan import image_fingerprints, scan
    from shelfwright.tables import cut

    began, spark = time.time(), local_session()
    rows = cut(scan(spark, a.path), "scan")
    chat = http_chat(a.endpoint, a.model, a.api_key) if a.endpoint and a.model else None
    found = organize(rows.drop("text"), rows.select("id", "text").where("text is not null"), time.time(), a.rate, chat, image_fingerprints(rows))
    docs = write_documents(found, a.out, began)
    print("[OK] written to", a.out)
    print("[INFO]", json.dumps(docs["plan"]["summary"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
