"""Settings of the engine, read when an object is made, never at import."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Hosts of public services that an internal deployment must not talk to (fixed values).
PUBLIC_HOSTS = ("api.openai.com", "api.deepseek.com", "openai.com", "deepseek.com")


@dataclass(frozen=True)
class EngineConfig:
    theta: float = 0.75
    k_dense: int = 8
    k_sparse: int = 20
    k_fused: int = 8
    weight_dense: float = 0.65
    weight_sparse: float = 0.35
    boost: float = 1.25
    external_k: int = 3
    evidence_ttl_seconds: int = 600
    max_words: int = 500
    max_tokens: int = 900
    temperature: float = 0.2
    chunk_size: int = 500
    chunk_overlap: int = 50
    window_size: int = 2200
    window_overlap: int = 200
    service_url: str = "http://localhost:9000"
    refer_message: str = "Please discuss this concern with your physician during the preoperative communication."
    context: str = "patients scheduled for radical prostatectomy for prostate cancer"

    @classmethod
    def from_env(cls, prefix: str = "DOCLOOM_") -> EngineConfig:
        """Defaults, overridden by environment variables such as DOCLOOM_THETA."""
        given = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items()})

    def assert_internal(self) -> None:
        if any(host in self.service_url for host in PUBLIC_HOSTS):
            raise ValueError(f"the service must be an internal one, not {self.service_url}")
