"""Configurations and value mappings from EDN or YAML; both give the same tree."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import yaml

from weft.functions.exprs import invert_mapping
from weft.sources import edn
from weft.sources.edn import Glob, Keyword


def local(key: object) -> str:
    """The name of a key without its namespace."""
    return str(key).rpartition("/")[2]


def _keyworded(value: object) -> object:
    """YAML strings with a leading colon are keywords; ``{glob: [folder, pattern]}`` is a glob."""
    if isinstance(value, str):
        return Keyword(value[1:]) if value.startswith(":") and len(value) > 1 else value
    if isinstance(value, list):
        return [_keyworded(v) for v in value]
    if isinstance(value, dict):
        if len(value) == 1 and local(next(iter(value))).lstrip("#") == "glob":
            return Glob(*next(iter(value.values())))
        out = {}
        for key, inner in value.items():
            name = local(key)
            if name in ("variables", "indexed-by") and isinstance(inner, dict):  # raw names stay text
                out[Keyword(key)] = {str(k): _keyworded(v) for k, v in inner.items()}
            else:
                out[Keyword(str(key).lstrip(":"))] = _keyworded(inner)
        return out
    return value


def read_config(path: str) -> dict:
    """Read by extension: .edn, .yaml or .yml."""
    kind = Path(path).suffix.lower()
    if kind == ".edn":
        found = edn.read_file(path)
    elif kind in (".yaml", ".yml"):
        with open(path, encoding="utf-8") as file:
            found = _keyworded(yaml.safe_load(file))
    else:
        raise ValueError(f"{path}: a configuration is .edn, .yaml or .yml")
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a configuration is a map")
    return found


def without_files(tree: object, kept: Sequence[str]) -> object:
    """A configuration without the jobs whose files lie in folders other than ``kept`` (globs only); literals stay."""
    if isinstance(tree, list):
        inner = [without_files(v, kept) for v in tree]
        return [v for v in inner if v is not None]
    if isinstance(tree, dict):
        for key, value in tree.items():
            if local(key).startswith("input-") and isinstance(value, Glob) and value.folder not in kept:
                return None
        return {k: v for k, v in ((k, without_files(v, kept)) for k, v in tree.items()) if v is not None and v != []}
    return tree


def _raws(raw: object) -> list[str]:
    return [str(r) for r in raw] if isinstance(raw, (list, tuple, set, frozenset)) else [str(raw)]


def compile_mappings(document: dict) -> dict[str, dict[str, object]]:
    """``{attribute: {raw: canonical}}`` from named mappings and the attributes that use them."""
    parts = {local(k): v for k, v in document.items()}
    missing = {"mappings", "variables"} - set(parts)
    if missing:
        raise ValueError(f"a mapping file has mappings and variables; {sorted(missing)} missing")
    inverted = {str(name): invert_mapping({k: _raws(v) for k, v in table.items()}) for name, table in parts["mappings"].items()}
    out = {}
    for attribute, name in parts["variables"].items():
        if str(name) not in inverted:
            raise ValueError(f"{attribute} uses a mapping {name} that isn't there")
        out[str(attribute)] = {raw: str(v) if isinstance(v, Keyword) else v for raw, v in inverted[str(name)].items()}
    return out


def check_mapping_enums(mappings: dict[str, dict[str, object]], enums: set[str]) -> None:
    """Canonical values with a namespace must be idents that the schema knows."""
    unknown = sorted({str(v) for table in mappings.values() for v in table.values() if isinstance(v, str) and "/" in v} - enums)
    if unknown:
        raise ValueError(f"mapping to unknown enum values: {unknown}")
