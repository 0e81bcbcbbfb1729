"""What happened in an output folder: an append-only journal of events, from which all questions are answered, and a guard.

Each line of the journal is one JSON event: a scan begins, a stage ends, a scan ends. Nothing is ever rewritten, so a scan that is
killed leaves all earlier events whole; a torn last line is passed over.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from .. import __version__

EXIT_OK, EXIT_DEPENDENCY, EXIT_STAGE, EXIT_LOCKED = 0, 2, 4, 5


def moment() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


class Journal:
    """Events of one folder. A stage counts as done for one source and one set of options, its `subject`."""

    def __init__(self, folder: Path, source: str, options: dict[str, Any] | None = None):
        self.folder, self.source = folder, source
        self.events_path, self.guard_path = folder / "docsignal-events.jsonl", folder / "docsignal.guard"
        self.subject = hashlib.sha256(json.dumps({"source": source, "options": options or {}}, sort_keys=True, default=str).encode()).hexdigest()[:20]
        self.scan = 0

    @contextlib.contextmanager
    def guarded(self) -> Iterator[None]:
        """Only one process at a time writes to the folder; another one leaves with EXIT_LOCKED."""
        self.folder.mkdir(parents=True, exist_ok=True)
        fd = os.open(self.guard_path, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                owner = os.pread(fd, 200, 0).decode("utf-8", "replace") or "another process"
                print(f"{self.folder} is in use by {owner}", flush=True)
                raise SystemExit(EXIT_LOCKED) from None
            os.ftruncate(fd, 0)
            os.pwrite(fd, f"process {os.getpid()} since {moment()}".encode(), 0)
            yield
        finally:
            os.close(fd)  # which also frees it

    def add(self, event: str, **what: Any) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        line = json.dumps({"event": event, "at": moment(), "scan": self.scan, **what}, ensure_ascii=False) + "\n"
        with self.events_path.open("a+b") as f:
            end = f.seek(0, os.SEEK_END)
            f.seek(max(0, end - 1))
            torn = f.read(1) not in (b"", b"\n")
            f.write((("\n" if torn else "") + line).encode())
            f.flush()
            os.fsync(f.fileno())

    def events(self) -> Iterator[dict[str, Any]]:
        if self.events_path.exists():
            with self.events_path.open(encoding="utf-8", errors="replace") as f:
                for line in f:
                    with contextlib.suppress(json.JSONDecodeError):
                        yield json.loads(line)

    def begin(self, arguments: list[str], stages: list[str]) -> int:
        """Number of the new scan."""
        self.scan = 1 + max((e["scan"] for e in self.events()), default=0)
        self.add("scan_begins", source=self.source, arguments=arguments, stages=stages, engine=__version__)
        return self.scan

    def stage(self, name: str, code: int, begun: str, table: str = "") -> None:
        self.add("stage_ends", stage=name, code=code, begun=begun, table=table, subject=self.subject)

    def end(self, code: int) -> None:
        self.add("scan_ends", code=code)

    def last(self, stage: str) -> dict[str, Any] | None:
        """The last end of a stage, whatever its subject."""
        out = None
        for e in self.events():
            if e["event"] == "stage_ends" and e["stage"] == stage:
                out = e
        return out

    def done(self, stage: str) -> bool:
        """Whether the stage's last end was a good one, for this subject."""
        e = self.last(stage)
        return bool(e) and e["code"] == EXIT_OK and e["subject"] == self.subject

    def scans(self) -> list[dict[str, Any]]:
        """One record a scan: number, source, arguments, stages, begun, ended and code (null while it runs or if it was killed)."""
        out: dict[int, dict[str, Any]] = {}
        for e in self.events():
            if e["event"] == "scan_begins":
                out[e["scan"]] = {"scan": e["scan"], "source": e["source"], "arguments": e["arguments"], "stages": e["stages"], "begun": e["at"], "ended": None, "code": None}
            elif e["event"] == "scan_ends" and e["scan"] in out:
                out[e["scan"]] |= {"ended": e["at"], "code": e["code"]}
        return list(out.values())
