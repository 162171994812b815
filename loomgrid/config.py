"""Typed settings of the engine: defaults, then environment (LOOMGRID_<NAME>), then keyword arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    #: The defaults of the generator and of file sizes.
    base_path: str = "/tmp/loomgrid"
    users: int = 100_000
    merchants: int = 5_000
    devices: int = 50_000
    transactions: int = 1_000_000
    days: int = 35
    hot_users: int = 100
    hot_share: float = 0.30
    null_device_share: float = 0.02
    seed: int = 42
    small_file_mb: int = 32
    target_file_mb: int = 192
    small_ratio: float = 0.30
    shuffle_partitions: int = 200

    def __post_init__(self):
        for name in ("users", "merchants", "devices", "transactions", "days", "shuffle_partitions"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("hot_share", "null_device_share", "small_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be a share")


def load(**given) -> Settings:
    """Fails at once on an unknown name or a value that is not of the field's type."""
    known = {f.name: type(f.default) for f in fields(Settings)}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    env = {k: t(os.environ[f"LOOMGRID_{k.upper()}"]) for k, t in known.items() if f"LOOMGRID_{k.upper()}" in os.environ}
    return replace(Settings(), **{**env, **given})
