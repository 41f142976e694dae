"""Settings of the command line, from the environment: MARLSTONE_ and the field's name in capitals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    #: "module:function" of the models; without them only sparse search, and the stand-in for answers.
    embed: str = ""
    chat: str = ""
    system_prompt: str = ""
    force_prompt: str = ""
    mode: str = "sparse"
    k: int = 5
    dims: int = 0
    #: Where source files are put, and where their links begin.
    objects: str = ""
    bucket: str = "sources"
    base_url: str = ""
    #: Folders of the registry and of logs.
    registry: str = "data/registry"
    logs: str = "data/manual_runs"

    @staticmethod
    def load(environ: Mapping[str, str] = os.environ) -> Settings:
        given = {f.name: environ[f"MARLSTONE_{f.name.upper()}"] for f in fields(Settings) if f"MARLSTONE_{f.name.upper()}" in environ}
        return Settings(**{n: int(v) if isinstance(getattr(Settings, n), int) else v for n, v in given.items()})

    def shown(self) -> dict[str, str]:
        """For manifests and logs."""
        return {n: str(v) for n, v in asdict(self).items()}
