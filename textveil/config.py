"""Settings, passed explicitly: executors never read them from their environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """The defaults, which must equal those of the service whose results this engine matches.

    ``salt`` is a literal of every plan that pseudonymizes, so explained plans and event logs show it:
    pseudonyms are made by expressions of the engine, which have no other way to a value. Keep plans and
    event logs of pseudonymizing jobs as protected as pseudonym maps, which hold the originals themselves.
    """

    mask_char: str = "*"
    preserve_last: int = 4
    salt: str = "project_default_salt"
    prefix: str = "PSEUDO"
    model: str = "gemini-1.5-flash"
    prompt: str = "Analyze this anonymized customer report. Provide a summary and two key recommendations:\n\n"
    temperature: float = 0.3
    max_tokens: int = 512

    def __post_init__(self):
        # An empty mask or salt means the default.
        if not self.mask_char:
            object.__setattr__(self, "mask_char", "*")
        if not self.salt:
            object.__setattr__(self, "salt", "project_default_salt")
        if self.preserve_last < 1:
            raise ValueError("preserve_last is 1 at least: 0 would append the whole value in clear")
