"""Folders and files of a checkout, listed and read through Hadoop's file systems, and the rules of ignore files."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tiergraph.errors import InvalidInput, NotFound

MAX_FILE_CHARS = 32_768


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def glob(spark: SparkSession, pattern: str) -> list[Any]:
    """Statuses of what a pattern names, hidden names too."""
    fs, p = _at(spark, pattern)
    return list(fs.globStatus(p) or [])


def inside(root: str, relative: str) -> str:
    """The full path of a path below root; one that climbs out, or is no path below, is refused."""
    if relative.startswith("/") or ".." in relative.split("/") or re.match(r"^[A-Za-z]:", relative):
        raise InvalidInput(f"path traversal not allowed: {relative}")
    clean = "/".join(x for x in relative.split("/") if x not in ("", "."))
    return f"{root.rstrip('/')}/{clean}" if clean else root.rstrip("/")


def _stays(spark: SparkSession, root: str, full: str) -> bool:
    """Whether a path, its links followed, lies below root. Only local files have links that lead elsewhere."""
    import os

    local = [re.sub(r"^file:/*", "/", x) for x in (root, full)]
    if any(re.match(r"^[a-z0-9]+:", x) for x in local):
        return True
    base, real = (os.path.realpath(x) for x in local)
    return real == base or real.startswith(base + "/")


def list_directory(spark: SparkSession, root: str, relative: str, ids: dict[str, str]) -> list[dict]:
    """DC2. What a folder of a checkout holds, folders first, then by shown path: path, name, entity_id, indexed, is_dir.

    ids maps paths to entities; a folder that is at the root is also known by ./ and its name.
    """
    full = inside(root, relative)
    fs, p = _at(spark, full)
    if not fs.exists(p):
        raise NotFound(f"path not found: {relative}")
    if not _stays(spark, root, full):
        raise InvalidInput("path escapes repo root")
    if fs.getFileStatus(p).isFile():
        raise InvalidInput(f"path is a file, not a directory: {relative}")
    below = full[len(root.rstrip("/")) + 1 :]
    out = []
    for s in fs.listStatus(p):
        name, is_dir = s.getPath().getName(), s.isDirectory()
        own = ids.get(f"{below}/{name}" if below else name) or (None if below else ids.get(f"./{name}"))
        out.append({"path": f"{name}/" if is_dir else name, "name": name, "entity_id": own, "indexed": own is not None, "is_dir": is_dir})
    return sorted(out, key=lambda e: (not e["is_dir"], e["path"]))


def read_file(spark: SparkSession, root: str, relative: str) -> str:
    """DC2. A file's text, MAX_FILE_CHARS characters of it at most, the last three of a longer one being dots."""
    full = inside(root, relative)
    fs, p = _at(spark, full)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        raise NotFound(f"file not found on disk: {relative}")
    if not _stays(spark, root, full):
        raise InvalidInput("path escapes repo root")
    stream = fs.open(p)
    try:
        # four bytes a character at most, and one more to see that there is more
        data = bytes(stream.readNBytes(4 * (MAX_FILE_CHARS + 1)))
    finally:
        stream.close()
    text = data.decode("utf-8", "ignore")
    return text if len(text) <= MAX_FILE_CHARS else text[: MAX_FILE_CHARS - 3] + "..."


def _pattern(glob_: str) -> str:
    """A pattern of an ignore file, without its leading or trailing slash, as a regular expression."""
    out, k = "", 0
    while k < len(glob_):
        c = glob_[k]
        if glob_.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if glob_.startswith("/**", k) and k + 3 == len(glob_):
            out, k = out + "/.+", k + 3
            continue
        if c == "*":
            out += ".*" if glob_.startswith("**", k) else "[^/]*"
            k += glob_.startswith("**", k)
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob_[k + 2 :]:
            end = glob_.index("]", k + 2)
            body = glob_[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "\\" and k + 1 < len(glob_):
            k += 1
            out += re.escape(glob_[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def ignore_rules(texts: dict[str, str]) -> list[tuple[str, bool, bool]]:
    """(regular expression over a path from the root, folders only, ignore) of ignore files (path to text), outer files and earlier lines first."""
    rules = []
    for path in sorted(texts, key=lambda p: (p.count("/"), p)):
        folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
        for line in texts[path].splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            ignore = not line.startswith("!")
            line = line if ignore else line[1:]
            folders = line.endswith("/")
            line = line.rstrip("/") if folders else line
            anywhere = "" if "/" in line else "(?:.*/)?"
            rules.append((f"^{re.escape(folder)}{anywhere}{_pattern(line.lstrip('/'))}$", folders, ignore))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a file is hidden or ignored: itself, or any folder that holds it, by the last rule that names that."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("p"), (n < F.size(parts)).alias("folder")))

    def named(step: Column) -> Column:
        out = F.lit(False)
        for pattern, folders, ignore in rules:
            hit = step["p"].rlike(pattern)
            out = F.when(hit & step["folder"] if folders else hit, F.lit(ignore)).otherwise(out)
        return out

    hidden = path.rlike(r"(^|/)\.[^/]")
    return hidden | F.exists(steps, named) if rules else hidden


def ignore_files(spark: SparkSession, root: str, depth: int) -> dict[str, str]:
    """Path from the root to text of .ignore files down to a depth, and of .gitignore files in a git checkout."""
    root = root.rstrip("/")
    names = [".ignore"] + ([".gitignore"] if glob(spark, f"{root}/.git") else [])
    out = {}
    for name in names:
        for d in range(depth + 1):
            for s in glob(spark, f"{root}{'/*' * d}/{name}"):
                fs, p = _at(spark, s.getPath().toString())
                stream = fs.open(p)
                try:
                    text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
                finally:
                    stream.close()
                full = re.sub(r"^[a-z0-9]+:/+", "/", s.getPath().toString())
                out[full[len(re.sub(r"^[a-z0-9]+:/+", "/", root)) + 1 :]] = text
    return out


def package_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of the __init__.py files that tell Python packages, which Spark's readers pass over as hidden."""
    base = re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/"))
    found = [s.getPath().toString() for p in ("*", "*/*", "src/*", "src/*/*") for s in glob(spark, f"{root.rstrip('/')}/{p}/__init__.py")]
    return sorted({re.sub(r"^[a-z0-9]+:/+", "/", f)[len(base) + 1 :] for f in found})
