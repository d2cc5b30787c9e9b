"""What a project's manifest files declare: language and dependencies, read by one Arrow-batched function."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"^\s*([A-Za-z0-9._-]+)")


def _keys(data: object, *paths: str) -> Iterable[str]:
    for path in paths:
        block = data
        for part in path.split("."):
            block = block.get(part) if isinstance(block, dict) else None
        if isinstance(block, dict):
            yield from (str(k) for k in block)
        elif isinstance(block, list):
            yield from (m.group(1) for m in (_NAME.match(str(x)) for x in block) if m)


def _yaml_section(text: str, *names: str) -> Iterable[str]:
    """Keys or list items directly below top-level sections."""
    inside, depth = False, None
    for line in text.splitlines():
        if re.match(r"^\S", line):
            inside, depth = line.split(":")[0] in names, None
        elif inside and line.strip() and not line.strip().startswith("#"):
            indent = len(line) - len(line.lstrip())
            depth = indent if depth is None else depth
            found = re.match(r"^-?\s*([\w.@/-]+)", line.strip())
            if indent == depth and found:
                yield found.group(1)


def _pyproject(text: str) -> Iterable[str]:
    data = tomllib.loads(text)
    yield from _keys(data, "project.dependencies")
    for group in (data.get("project", {}).get("optional-dependencies") or {}).values():
        yield from (m.group(1) for m in map(_NAME.match, group) if m)
    yield from (k for k in _keys(data, "tool.poetry.dependencies") if k != "python")


#: File name to language and reader.
READERS: dict[str, tuple[str, Callable[[str], Iterable[str]]]] = {
    "pubspec.yaml": ("dart", lambda t: _yaml_section(t, "dependencies", "dev_dependencies")),
    "package.json": ("javascript", lambda t: _keys(json.loads(t), "dependencies", "devDependencies", "peerDependencies")),
    "pyproject.toml": ("python", _pyproject),
    "requirements.txt": ("python", lambda t: (m.group(1) for m in map(_NAME.match, (x for x in t.splitlines() if not x.strip().startswith(("#", "-")))) if m)),
    "Pipfile": ("python", lambda t: _keys(tomllib.loads(t), "packages", "dev-packages")),
    "environment.yml": ("python", lambda t: _yaml_section(t, "dependencies")),
    "Cargo.toml": ("rust", lambda t: _keys(tomllib.loads(t), "dependencies", "dev-dependencies")),
    "go.mod": ("go", lambda t: re.findall(r"(?m)^\s*(?:require\s+)?([\w./-]+)\s+v\d", t)),
    "Gemfile": ("ruby", lambda t: re.findall(r"""(?m)^\s*gem\s+['"]([\w-]+)""", t)),
    "composer.json": ("php", lambda t: _keys(json.loads(t), "require", "require-dev")),
    "build.gradle": ("kotlin", lambda t: (b for _, b in re.findall(r"""['"]([\w.-]+):([\w.-]+):""", t))),
    "project.csproj": ("csharp", lambda t: re.findall(r'PackageReference\s+Include="([^"]+)"', t)),
}


def normal_dependency(name: str) -> str:
    """Without extras, versions and markers, in lower case."""
    return re.split(r"[\[<>=!~;\s]", name.strip().lower(), maxsplit=1)[0]


def parse(name: str, text: str) -> tuple[str, list[str]] | None:
    key = "project.csproj" if name.endswith(".csproj") else "build.gradle" if name.startswith("build.gradle") else "requirements.txt" if re.fullmatch(r"requirements[\w.-]*\.txt", name) else name
    if key not in READERS:
        return None
    language, read = READERS[key]
    try:
        return language, sorted({d for d in map(normal_dependency, read(text)) if d})
    except (ValueError, TypeError, AttributeError):
        return language, []


@F.pandas_udf(T.StructType([T.StructField("language", T.StringType()), T.StructField("dependencies", T.ArrayType(T.StringType()))]))
def manifest(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Null language for files that are no manifests; unreadable ones have a language and no dependencies."""
    found = [(None if n is None or t is None else parse(n, t)) or (None, None) for n, t in zip(names, texts)]
    return pd.DataFrame(found, columns=["language", "dependencies"])


def frameworks(dependencies: Column, markers: dict[str, str]) -> Column:
    """The frameworks that a set of dependencies stands for, by a given table of markers."""
    table = F.create_map(*(F.lit(x) for p in markers.items() for x in p))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(dependencies, lambda x: F.try_element_at(table, x)))))
