"""How an agent service would be started in a container: its settings, checks and command, never run here."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

#: Where the host's folders stand in the container, and whether it may write there.
MOUNTS = {"input": "ro", "skills": "ro", "output": "rw", "logs": "rw"}
PORT = 8765


@dataclass(frozen=True)
class Service:
    """Settings of a service container; folders are host paths."""

    input: Path
    skills: Path
    output: Path
    logs: Path
    image: str
    module: str
    name: str = "agent-service"
    host: str = "127.0.0.1"
    port: int = PORT
    cli: str = "docker"
    key_variable: str = "MODEL_API_KEY"
    memory: str | None = "4g"
    cpus: float | None = None
    script_timeout: int = 120
    tool_timeout: float = 180.0
    extra: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in MOUNTS:
            object.__setattr__(self, name, Path(getattr(self, name)).expanduser())
        for fault, bad in {"port must lie in 1..65535": not 1 <= self.port <= 65535, "timeouts must be positive": min(self.script_timeout, self.tool_timeout) <= 0, "cpus must be positive": self.cpus is not None and self.cpus <= 0}.items():
            if bad:
                raise ValueError(fault)

    @property
    def url(self) -> str:
        return f"http://{self.host}:{self.port}"

    def faults(self) -> list[str]:
        """What on this host stands in the way of a start."""
        found = [f"command not found: {self.cli}"] * (shutil.which(self.cli) is None)
        found += [f"missing API key: set {self.key_variable}"] * (not os.environ.get(self.key_variable))
        found += [f"{name} directory does not exist: {getattr(self, name)}" for name in ("input", "skills") if not getattr(self, name).is_dir()]
        if self.skills.is_dir() and not any(self.skills.glob("*/SKILL.md")):
            found.append(f"skills directory contains no immediate SKILL.md entries: {self.skills}")
        return found

    def command(self) -> list[str]:
        """The container command: folders mounted, limits set, the key passed on by name only."""
        settings = {"PYTHONUNBUFFERED": 1, "AGENT_PORT": PORT, "AGENT_SCRIPT_TIMEOUT": self.script_timeout, "AGENT_TOOL_TIMEOUT": self.tool_timeout}
        settings |= {f"AGENT_{name.upper()}_DIR": f"/workspace/{name}" for name in MOUNTS}
        out = [self.cli, "run", "-d", "--name", self.name, "-p", f"{self.host}:{self.port}:{PORT}"]
        for name, mode in MOUNTS.items():
            out += ["-v", volume(getattr(self, name), f"/workspace/{name}", mode)]
        out += ["-e", self.key_variable]
        for name, value in settings.items():
            out += ["-e", f"{name}={value}"]
        out += ["--memory", self.memory] if self.memory else []
        out += ["--cpus", str(self.cpus)] if self.cpus is not None else []
        return [*out, *self.extra, self.image, "python", "-m", self.module]


def volume(host: Path, inside: str, mode: str) -> str:
    return f"{Path(host).resolve().as_posix()}:{inside}:{mode}"


def unique_name(prefix: str = "agent-service") -> str:
    return f"{prefix}-{uuid.uuid4().hex[:12]}"
