"""The configuration file of a root: absent means the defaults, an invalid one is an error."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass

from srcatlas.functions.policy import DEFAULT_MAX_BYTES, parse_size

CONFIG_NAME = ".srcatlasrc.toml"


@dataclass(frozen=True)
class Config:
    max_file_size: int = DEFAULT_MAX_BYTES
    allow_sensitive: bool = False
    include_hidden: bool = False

    def as_dict(self) -> dict:
        return asdict(self)


def parse_config(text: str) -> Config:
    """ValueError for broken TOML, a wrong type or an impossible size; unknown keys do not matter."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"no valid configuration: {e}") from None
    size = data.get("max_file_size", DEFAULT_MAX_BYTES)
    if isinstance(size, str):
        size = parse_size(size)
    flags = {k: data.get(k, False) for k in ("allow_sensitive", "include_hidden")}
    if isinstance(size, bool) or not isinstance(size, int) or size < 0 or not all(isinstance(v, bool) for v in flags.values()):
        raise ValueError("no valid configuration")
    return Config(size, **flags)


def load_config(root: str) -> Config:
    try:
        with open(os.path.join(root, CONFIG_NAME), encoding="utf-8") as f:
            return parse_config(f.read())
    except FileNotFoundError:
        return Config()
