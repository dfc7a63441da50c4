"""Configuration of a translation project, checked on creation [SRC11], and small helpers around it."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field

from .functions.text import LOCALE


@dataclass(frozen=True)
class Config:
    """Defaults apply where nothing is given; ValueError for anything out of range."""

    source_locale: str
    target_locales: tuple[str, ...]
    messages_dir: str = "./messages"
    mode: str = "keys"
    inline_component: str | None = None
    split_by_namespace: bool = False
    batch_size: int = 50
    target_batch_tokens: int = 2000
    retries: int = 2
    concurrency: int = 3
    validate_placeholders: bool = True
    tone: str | None = None
    glossary: dict[str, str] = field(default_factory=dict)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_usd: float | None = None

    def __post_init__(self) -> None:
        bad = [x for x in (self.source_locale, *self.target_locales) if not re.match(LOCALE, x)]
        if bad:
            raise ValueError(f"not a locale: {', '.join(map(repr, bad))}")
        if self.mode not in ("keys", "inline"):
            raise ValueError("mode is keys or inline")
        if self.mode == "inline" and not self.inline_component:
            raise ValueError("mode inline needs inline_component")
        for name, least in (("batch_size", 1), ("target_batch_tokens", 1), ("retries", 0), ("concurrency", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} is {least} at least")
        if self.max_usd is not None and self.max_usd <= 0:
            raise ValueError("max_usd is positive")

    @property
    def targets(self) -> tuple[str, ...]:
        """Target locales without the source's [FLT9]."""
        return tuple(x for x in self.target_locales if x != self.source_locale)


def parse_flag(args: list[str], name: str) -> str | None:
    """The value of --name=x or --name x; None if it is missing or another flag follows [FLT13]."""
    for i, a in enumerate(args):
        if a.startswith(f"--{name}="):
            return a[len(name) + 3 :]
        if a == f"--{name}":
            return args[i + 1] if i + 1 < len(args) and not args[i + 1].startswith("-") else None
    return None


def upsert_section(content: str, heading: str, section: str) -> str:
    """Markdown with the section under `heading` replaced, up to the next heading of its level or above; added at the end if missing [SNK9]."""
    level = len(heading) - len(heading.lstrip("#"))
    lines, out, skip, done, fence = content.split("\n"), [], False, False, False
    for line in lines:
        fence ^= line.startswith("```")
        if not fence and line.strip() == heading.strip() and not done:
            out += [section.rstrip("\n"), ""]
            skip = done = True
            continue
        if skip and not fence and re.match(rf"#{{1,{level}}} ", line):
            skip = False
        if not skip:
            out.append(line)
    text = "\n".join(out).rstrip("\n")
    return (text if done else f"{text}\n\n{section.rstrip()}" if text else section.rstrip()) + "\n"


def alias_targets(source: str, aliases: dict[str, list[str]]) -> list[str]:
    """Places that an aliased import may mean: exact aliases, and those ending in *, the longest prefix first [SRC10, WIN14]."""
    out = []
    for pattern in sorted(aliases, key=lambda p: -len(p.removesuffix("*"))):
        if pattern.endswith("*") and source.startswith(pattern[:-1]):
            out += [t.replace("*", source[len(pattern) - 1 :], 1) for t in aliases[pattern]]
        elif pattern == source:
            out += aliases[pattern]
    return out


def path_aliases(tsconfig: str | None, jsconfig: str | None = None) -> list[tuple[str, bool, list[str]]]:
    """(prefix, exact, targets from the project's root) of the first of two configurations that can be read, the longest prefix first [SRC10]. Comments are allowed; a configuration without paths gives none."""
    for text in (tsconfig, jsconfig):
        try:
            options = json.loads(re.sub(r"(?m)^\s*//.*$", "", re.sub(r"(?s)/\*.*?\*/", "", text or ""))).get("compilerOptions") or {}
        except (ValueError, AttributeError):
            continue
        base, out = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else ".", []
        for pattern, places in (options.get("paths") or {}).items():
            wild = pattern.endswith("/*")
            targets = [posixpath.normpath(posixpath.join(base, p[:-1] if wild and p.endswith("/*") else p)) for p in places if isinstance(p, str)] if isinstance(places, list) else []
            if targets:
                out.append((pattern[:-1] if wild else pattern, not wild, targets))
        return sorted(out, key=lambda x: -len(x[0]))
    return []


def include_patterns(folders: set[str]) -> list[str]:
    """Globs for a project with these top-level folders (src's as 'src/x'): known ones, src first; else everything [SRC9]."""
    known = ["app", "pages", "components"]
    found = [f"src/{k}/**/*.tsx" for k in known if f"src/{k}" in folders] or [f"{k}/**/*.tsx" for k in known if k in folders]
    return found or ["**/*.tsx", "**/*.jsx"]
