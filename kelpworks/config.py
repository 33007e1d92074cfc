"""Settings: defaults, then a TOML file, then the environment.

A file that cannot be read or is not valid TOML is ignored with a warning; unknown tables and keys are ignored,
values of another type than the default's, too. `KELPWORKS_<TABLE>_<KEY>` overrides one value.
"""

from __future__ import annotations

import dataclasses
import os
import tomllib
import warnings
from dataclasses import dataclass, field

ENV = "KELPWORKS_"


# The settings and their defaults, as the engine this follows has them.


@dataclass
class Index:
    exclude: list[str] = field(default_factory=lambda: ["docs/generated/**", "**/*.min.js"])
    languages: list[str] = field(default_factory=lambda: ["rust", "typescript", "python"])


@dataclass
class Search:
    hybrid_alpha: float = 0.5


@dataclass
class Pack:
    default_token_budget: int = 50_000


@dataclass
class Locate:
    max_file_bytes: int = 10_485_760


@dataclass
class LocateSmart:
    enabled: bool = False
    provider: str = ""
    model: str = ""
    endpoint: str = ""
    max_steps: int = 4
    max_output_tokens: int = 1024


@dataclass
class Config:
    index: Index = field(default_factory=Index)
    search: Search = field(default_factory=Search)
    pack: Pack = field(default_factory=Pack)
    locate: Locate = field(default_factory=Locate)
    locate_smart: LocateSmart = field(default_factory=LocateSmart)

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        config = cls()
        if path and os.path.exists(path):
            try:
                with open(path, "rb") as f:
                    config._take(tomllib.load(f))
            except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                warnings.warn(f"{path} is ignored: {e}", stacklevel=2)
                config = cls()
        config._override(os.environ if env is None else env)
        return config

    def _take(self, data: dict) -> None:
        for table in dataclasses.fields(self):
            part, given = getattr(self, table.name), data.get(table.name)
            for key in dataclasses.fields(part):
                if isinstance(given, dict) and key.name in given:
                    new, old = given[key.name], getattr(part, key.name)
                    if isinstance(old, float) and type(new) is int:
                        new = float(new)
                    if type(new) is type(old):
                        setattr(part, key.name, new)

    def _override(self, env) -> None:
        for table in dataclasses.fields(self):
            part = getattr(self, table.name)
            for key in dataclasses.fields(part):
                text = env.get(f"{ENV}{table.name}_{key.name}".upper())
                if text is None:
                    continue
                old = getattr(part, key.name)
                if isinstance(old, bool):
                    setattr(part, key.name, text.lower() in ("true", "1"))
                elif isinstance(old, list):
                    setattr(part, key.name, [x.strip() for x in text.split(",") if x.strip()])
                else:
                    try:
                        setattr(part, key.name, type(old)(text))
                    except ValueError:
                        warnings.warn(f"{text!r} is no {type(old).__name__}; {table.name}.{key.name} stays {old!r}", stacklevel=2)
