"""Settings of an engine: defaults, overridden by a file, overridden by the environment."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

#: What a scan leaves out.
IGNORE_PATTERNS = [
    *["node_modules/**", "vendor/**", "__pycache__/**", ".venv/**", "dist/**", "build/**", "out/**", ".next/**", "target/**", ".git/**"],
    *["*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.bmp", "*.webp", "*.woff", "*.woff2", "*.ttf", "*.eot"],
    *["*.mp3", "*.mp4", "*.wav", "*.avi", "*.mkv", "*.webm", "*.zip", "*.tar", "*.gz", "*.rar", "*.7z"],
    *["*.exe", "*.dll", "*.so", "*.dylib", "*.bin", "*.class", "*.jar", "*.war", "*.ear"],
    *["*.min.js", "*.min.css", "*.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "data/**"],
]
#: The defaults.
DEFAULTS: dict[str, Any] = {
    "project_dir": ".",
    "data_dir": "data",
    "indexing": {
        "auto_index": True,
        "max_file_size": 1 << 20,
        "max_files": 50_000,
        "token_multiplier": 3.5,
        "languages": ["js", "ts", "jsx", "tsx", "py", "rs", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt"],
        "also_text": ["md", "json", "yaml", "yml", "toml", "xml", "html", "css", "sql", "sh", "bat", "ps1"],
    },
    "assembly": {"budget": 40_000, "layers": {"fixed": 0.1, "short_term": 0.3, "associative": 0.4, "spare": 0.2}, "dependency_depth": 2},
    "search": {"k1": 1.2, "b": 0.75, "top_k": 10},
    "embedding": {"enabled": False, "provider": "hashing", "model": "nomic-embed-text", "endpoint": "http://127.0.0.1:11434"},
    "ignore": {"use_gitignore": True, "use_contextignore": True, "patterns": IGNORE_PATTERNS},
    "backup": {"max_backups": 10, "max_age_days": 30, "before_reindex": True},
    "access_log": {"max_age_days": 30},
    "history": {"enabled": True, "max_entries": 100, "max_hot_files": 30},
}
#: Environment variables and the settings that they override.
ENVIRONMENT = {
    "CONTEXTLAKE_PROJECT_DIR": ("project_dir",),
    "CONTEXTLAKE_DATA_DIR": ("data_dir",),
    "CONTEXTLAKE_BUDGET": ("assembly", "budget"),
    "CONTEXTLAKE_TOP_K": ("search", "top_k"),
    "CONTEXTLAKE_MAX_FILE_SIZE": ("indexing", "max_file_size"),
    "CONTEXTLAKE_MAX_FILES": ("indexing", "max_files"),
    "CONTEXTLAKE_EMBEDDING": ("embedding", "enabled"),
    "CONTEXTLAKE_EMBEDDING_PROVIDER": ("embedding", "provider"),
    "CONTEXTLAKE_EMBEDDING_MODEL": ("embedding", "model"),
    "CONTEXTLAKE_EMBEDDING_ENDPOINT": ("embedding", "endpoint"),
}


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; mappings are merged, all else, lists included, is replaced."""
    merged = dict(base)
    for key, value in over.items():
        old = merged.get(key)
        merged[key] = deep_merge(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return merged


def load_config(path: str | os.PathLike | None = None, environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The settings of a JSON file over the defaults, and the environment over both; folders come out absolute."""
    config = copy.deepcopy(DEFAULTS)
    base = Path.cwd()
    if path and Path(path).exists():
        config = deep_merge(config, json.loads(Path(path).read_text(encoding="utf-8")))
        base = Path(path).resolve().parent
    for name, keys in ENVIRONMENT.items():
        text = (os.environ if environment is None else environment).get(name)
        if text in (None, ""):
            continue
        place = config
        for key in keys[:-1]:
            place = place[key]
        old = place[keys[-1]]
        place[keys[-1]] = text.lower() in ("1", "true", "yes", "on") if isinstance(old, bool) else int(text) if isinstance(old, int) else text
    for key in ("project_dir", "data_dir"):
        config[key] = str((base / config[key]).resolve())
    return config
