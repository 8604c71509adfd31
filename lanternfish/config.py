"""Settings: defaults, then a JSON file, then environment variables (LANTERNFISH_<NAME>)."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from dataclasses import dataclass, field

log = logging.getLogger(__name__)
PREFIX = "LANTERNFISH_"
BACKENDS = ("segmented", "rewrite")
#: Least values (fixed values of the settings).
LEAST = {"chunk_size": 1, "ingest_rate_limit": 0, "ingest_rate_window": 1, "max_batch_ingest": 1, "max_batch_queries": 1, "top_k": 1}


@dataclass(frozen=True)
class Settings:
    """Every knob of the engine; instances are immutable and passed explicitly."""

    # Where things are.
    docs_path: str = "data/docs"
    index_dir: str = "data/index"
    chunk_store: str = "segmented"
    # Chunks and vectors.
    chunk_size: int = 400
    chunk_overlap: int = 50
    vector_model: str = "hashing"
    # Ranking.
    top_k: int = 3
    keyword_weight: float = 0.35
    vector_weight: float = 0.65
    # Bounds of a request.
    max_batch_ingest: int = 5
    max_batch_queries: int = 10
    max_html_chars: int = 5 << 20
    max_query_chars: int = 2000
    max_top_k: int = 50
    # Callers.
    api_keys: tuple[str, ...] = ()
    ingest_rate_limit: int = 30
    ingest_rate_window: int = 60
    log_level: str = "INFO"
    #: Keys of the file that no setting has; kept, not interpreted.
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        wrong = [f"{name} is {getattr(self, name)}, less than {low}" for name, low in LEAST.items() if getattr(self, name) < low]
        if not 0 <= self.chunk_overlap < self.chunk_size:
            wrong.append(f"windows of {self.chunk_size} words can't share {self.chunk_overlap}")
        if self.chunk_store not in BACKENDS:
            wrong.append(f"no chunk store {self.chunk_store!r} among {', '.join(BACKENDS)}")
        if wrong:
            raise ValueError("; ".join(wrong))


def comma_list(raw) -> tuple[str, ...]:
    """Non-empty, stripped items of a comma-separated text or a list."""
    items = raw if isinstance(raw, list | tuple) else str(raw).split(",")
    return tuple(s for s in (str(x).strip() for x in items) if s)


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings from the file at path (if any) and env (default: the process's). A bad env value is ignored with a warning."""
    env = os.environ if env is None else env
    kinds = {f.name: f.type for f in dataclasses.fields(Settings) if f.name != "extra"}
    values: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    extra = {k: values.pop(k) for k in list(values) if k not in kinds}
    for name, kind in kinds.items():
        raw = env.get(PREFIX + name.upper())
        if raw is None:
            continue
        try:
            values[name] = {"int": int, "float": float}.get(kind, comma_list if kind.startswith("tuple") else str)(raw)
        except ValueError:
            log.warning("%s%s stays as it was: %r can't be read as %s", PREFIX, name.upper(), raw, kind)
    if isinstance(values.get("api_keys"), list):
        values["api_keys"] = comma_list(values["api_keys"])
    return Settings(**values, extra=extra)
