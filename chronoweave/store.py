"""A folder of build manifests and cached feature tables, on any file system that Spark reads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from .sources import files
from .sources.files import content_hash, file_size  # noqa: F401

KEY_LENGTH = 16


def _digest(what: Any) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def definition_hash(feature: Any) -> str:
    return _digest(feature.definition())[:KEY_LENGTH]


class Store:
    """Builds under ``builds/<id>/build.json``, feature tables under ``cache/``.

    On a cluster the folder must be one that the executors see: they write the
    feature tables.
    """

    def __init__(self, path: str | Path = ".chronoweave"):
        self.path = files.qualified(path)

    def save_build(self, manifest: Mapping[str, Any]) -> str:
        target = f"{self.path}/builds/{manifest['build_id']}/build.json"
        files.write_text(target, json.dumps(manifest, indent=2, default=str))
        return target

    def list_builds(self) -> list[dict[str, Any]]:
        """All manifests, newest first."""
        found = [json.loads(files.read_bytes(f.path)) for f in files.data_files(f"{self.path}/builds") if f.path.endswith("/build.json")]
        return sorted(found, key=lambda m: m["created_at"], reverse=True)

    def get_build(self, build_id: str) -> dict[str, Any] | None:
        path = f"{self.path}/builds/{build_id}/build.json"
        return json.loads(files.read_bytes(path)) if files.exists(path) else None

    def cached_content_hash(self, path: str | Path) -> str | None:
        """The content hash, computed again only if sizes or times of the files changed."""
        found = files.data_files(path)
        if not found:
            return None
        memo = f"{self.path}/hashes/{_digest([(f.path, f.size, f.modified) for f in found])}"
        if not files.exists(memo):
            files.write_text(memo, content_hash(path))
        return files.read_bytes(memo).decode()

    def _source_hash(self, source: Any) -> str | None:
        path = getattr(source, "path", None)
        return self.cached_content_hash(path) if path is not None else None

    def feature_cache_key(self, feature: Any) -> str | None:
        """None where the source's content cannot be told: such features are not cached."""
        found = self._source_hash(feature.source)
        return None if found is None else _digest([feature.definition(), found])[:KEY_LENGTH]

    def feature_cache_path(self, name: str, key: str) -> str:
        return f"{self.path}/cache/{''.join(c if c.isalnum() else '_' for c in name)}__{key}.parquet"

    def has_feature_cache(self, name: str, key: str) -> bool:
        return files.exists(f"{self.feature_cache_path(name, key)}/_SUCCESS")

    def build_cache_key(self, labels: Any, features: Sequence[Any], options: Mapping[str, Any]) -> str | None:
        keys = [self.feature_cache_key(f) for f in features]
        spine = self.cached_content_hash(labels.path) if labels.path is not None else None
        if spine is None or None in keys:
            return None
        return _digest([spine, labels.keys, labels.label_time, labels.target, keys, options])[:KEY_LENGTH]

    def find_cached_build(self, key: str) -> dict[str, Any] | None:
        """The newest build of this key whose outputs are all still there."""
        for m in self.list_builds():
            paths = [m["output"]["path"], *(m.get("splits") or {}).values()]
            if m.get("build_cache_key") == key and all(p and files.exists(p) for p in paths):
                return m
        return None
