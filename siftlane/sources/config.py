"""Configuration on the driver: defaults, YAML, .env files, names and paths of outputs."""

from __future__ import annotations

import re
from pathlib import Path

DEFAULTS: dict = {
    "entities": "PERSON EMAIL_ADDRESS PHONE_NUMBER CREDIT_CARD IBAN_CODE IP_ADDRESS US_SSN".split(),
    "custom_keywords": [], "replacement": "█████", "output_dir": "redacted", "copy_unhandled": False, "decode_nested_json": True,
    "regex_only": False, "report": False, "timestamp_outputs": False, "include_extensions": [], "skip_extensions": [],
    "redact_filenames": False, "filename_min_match_len": 4, "names": [], "names_file": "names.md",
    "tight_image_boxes": False, "ocr": {"dpi": 200},  # for picture and PDF plug-ins
}
MARKERS = ("# names: begin", "# names: end")


def merge(base: dict, over: dict | None) -> dict:
    """Keys of over replace those of base, nested objects key by key; null leaves the default."""
    out = dict(base)
    for k, v in (over or {}).items():
        if v is not None:
            out[k] = {**base[k], **v} if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return out


def load(path: str | None) -> dict:
    return dict(DEFAULTS) if path is None else load_text(Path(path).read_text(encoding="utf-8"))


def load_text(text: str) -> dict:
    """A setting that nothing reads is named in a warning, as it may have been meant to protect something."""
    import warnings

    import yaml

    try:
        given = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"the configuration is no YAML: {e}") from e
    if unknown := sorted(set(given) - set(DEFAULTS)):
        warnings.warn(f"settings that nothing reads: {', '.join(unknown)}", stacklevel=2)
    return merge(DEFAULTS, given)


def splice(path: str, entries: str, write: bool = True, markers: tuple[str, str] = MARKERS) -> str:
    """The configuration with entries between its markers. With write it takes the file's place in one move, the old one
    kept beside it as .bak; what wouldn't load is never written."""
    import os

    from siftlane.operators.keywords import splice as between

    old = Path(path).read_text(encoding="utf-8")
    new = between(old, entries, *markers)
    load_text(new)
    if write:
        Path(f"{path}.bak").write_text(old, encoding="utf-8")
        part = Path(f"{path}.{os.getpid()}.part")
        part.write_text(new, encoding="utf-8")
        os.replace(part, path)
    return new


def env(text: str, inline_comments: bool = False) -> dict[str, str]:
    """KEY=value lines. Quotes at both ends go; with inline_comments what follows ' #' in an unquoted value goes too."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if not m:
            continue
        value = m.group(2)
        q = re.match(r"""(["'])(.*?)\1""", value)
        if q and (inline_comments or q.end() == len(value)):
            value = q.group(2)
        elif inline_comments:
            value = re.split(r"\s+#", value)[0].strip()
        else:
            value = value.strip("\"'")
        out[m.group(1)] = value
    return out


def resolve(key: str, cli: str | None, environ: dict, dotenv: dict) -> str | None:
    """Command line, then environment, then .env."""
    return next((v for v in (cli, environ.get(key), dotenv.get(key)) if v), None)


def report_path(cli: str | bool | None, configured: str | bool | None, default: str = "redaction-report.md") -> str | None:
    value = cli if cli is not None else configured
    return default if value is True else value or None
