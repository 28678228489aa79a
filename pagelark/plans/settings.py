"""Settings: environment over file over defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    use_mock: bool = True
    parser: str = "mock"
    retriever: str = "mock"
    financial_agent: str = "mock"
    predictor: str = "rule_based"
    retrieval_limit: int = 5
    data_dir: str = "data"


def _typed(value: object, like: object) -> object:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in TRUE
    return type(like)(value)


def file_values(text: str) -> dict[str, object]:
    """Values of a settings file: lines of `name: value`, with comments, quotes, true and false; blocks aren't read."""
    out: dict[str, object] = {}
    for line in text.splitlines():
        name, sign, value = line.partition(":")
        if not sign or name != name.strip() or name.startswith(("#", "-")):
            continue
        value = value.strip()
        if value[:1] in ("'", '"') and value.count(value[0]) > 1:
            out[name] = value[1 : value.index(value[0], 1)]
        elif plain := value.split(" #")[0].strip():
            out[name] = {"true": True, "false": False}.get(plain.lower(), plain)
    return out


def load(file_values: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None, prefix: str = "PAGELARK_") -> Settings:
    """Settings from the values of a file and from variables such as PAGELARK_USE_MOCK; unknown names are ignored."""
    environ = os.environ if environ is None else environ
    out = Settings()
    for f in fields(Settings):
        like = getattr(out, f.name)
        for source, name in ((file_values or {}, f.name), (environ, prefix + f.name.upper())):
            if name in source:
                out = replace(out, **{f.name: _typed(source[name], like)})
    return out
