"""Settings of a run, as the nested dictionary of a config file or as plain fields."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

Step = str | tuple[str, dict]


@dataclass
class Config:
    seed: int = 42
    test_size: float = 0.2
    token_max_len: int = 100
    vocab_size: int = 32_000
    short_tokenizing: bool = False
    no_valid: bool = False
    adverse_valid: bool = False
    valid_split_beforehand: bool = False
    augment_after_split: bool = False
    select_DC: list[Step] = field(default_factory=list)
    select_DA: list[str] = field(default_factory=list)

    @classmethod
    def from_mapping(cls, values: Mapping) -> Config:
        """From the parsed config file; sections are flattened, settings of others are left out."""
        flat = {**values, **values.get("train", {}), **values.get("option", {})}
        known = {k: v for k, v in flat.items() if k in cls.__dataclass_fields__}
        # An empty list in the file is read as nothing.
        return cls(**{k: v for k, v in known.items() if v is not None})
