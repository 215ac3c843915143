"""Identities and sessions, kept on the driver. Secrets are stored salted and stretched, and never logged."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import time
from dataclasses import dataclass, field


class AuthError(PermissionError):
    pass


def _stretched(secret: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, 200_000)


@dataclass
class Identity:
    name: str
    view: str
    salt: bytes
    password: bytes
    api_key: bytes | None = None
    collections: frozenset[str] = frozenset(["*"])


@dataclass
class Identities:
    lifetime_s: float = 3600.0
    by_name: dict[str, Identity] = field(default_factory=dict)
    sessions: dict[str, tuple[str, float]] = field(default_factory=dict)

    def create(self, name: str, password: str, view: str, api_key: str | None = None, collections: frozenset[str] = frozenset(["*"])) -> Identity:
        if name in self.by_name:
            raise AuthError("the name is taken")
        salt = secrets.token_bytes(16)
        self.by_name[name] = Identity(name, view, salt, _stretched(password, salt), _stretched(api_key, salt) if api_key else None, collections)
        return self.by_name[name]

    def _issue(self, name: str) -> str:
        token = secrets.token_urlsafe(32)
        self.sessions[token] = (name, time.time() + self.lifetime_s)
        return token

    def login(self, name: str, password: str | None = None, api_key: str | None = None) -> str:
        who = self.by_name.get(name)
        given, kept = (password, who.password) if who and password is not None else (api_key, who.api_key if who else None)
        if who is None or given is None or kept is None or not hmac.compare_digest(_stretched(given, who.salt), kept):
            raise AuthError("unknown name or wrong secret")
        return self._issue(name)

    def validate(self, token: str) -> Identity:
        name, until = self.sessions.get(token, ("", 0.0))
        if time.time() >= until:
            self.sessions.pop(token, None)
            raise AuthError("no such session")
        return self.by_name[name]

    def revoke(self, token: str) -> None:
        if self.sessions.pop(token, None) is None:
            raise AuthError("no such session")

    def refresh(self, token: str) -> str:
        who = self.validate(token)
        self.revoke(token)
        return self._issue(who.name)


def transport_allowed(production: bool, enabled: bool, certificate: bool, key: bool, client_ca: bool = False, require_client: bool = False) -> str | None:
    """None if the settings hold together, else what is wrong."""
    if not enabled:
        return "production needs encryption" if production else None
    if not (certificate and key):
        return "certificate and key belong together"
    return "client certificates need an authority" if require_client and not client_ca else None
