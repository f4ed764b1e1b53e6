"""Writers of answers that a deployment may plug in, and the one that stands in where there is none.

A provider runs on the driver, on a single answer's facts; it never sees a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol


class ProviderError(RuntimeError):
    """A provider can't do what was asked."""


@dataclass(frozen=True)
class Health:
    """Whether a provider can be used, and if not, why."""

    available: bool
    reason: str | None = None


class Provider(Protocol):
    """What can be plugged in; whatever fails raises ProviderError."""

    name: str

    def health(self) -> Health: ...

    def chat(self, messages: Sequence[Mapping[str, str]], *, schema: Mapping[str, Any] | None = None, limit: int | None = None) -> str: ...

    def describe_image(self, image: bytes, *, mime_type: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class Fallback:
    """Writes nothing, so deterministic answers stay as they are."""

    reason: str = "No provider is configured."
    name: str = "lexical_fallback"

    def health(self) -> Health:
        return Health(False, self.reason)

    def chat(self, messages: Sequence[Mapping[str, str]], *, schema: Mapping[str, Any] | None = None, limit: int | None = None) -> str:
        raise ProviderError(self.reason)

    def describe_image(self, image: bytes, *, mime_type: str, prompt: str) -> str:
        raise ProviderError(self.reason)


def choose(providers: Iterable[Provider]) -> Provider:
    """The first provider that can be used, else the fallback."""
    return next((p for p in providers if p.health().available), Fallback())


def worded(provider: Provider, deterministic: str, messages: Sequence[Mapping[str, str]]) -> tuple[str, str]:
    """(answer, name of its writer): the provider's text if it gives one, else the deterministic answer."""
    try:
        text = provider.chat(messages).strip()
    except ProviderError:
        text = ""
    return (text, provider.name) if text else (deterministic, "deterministic")
