"""Which files a scan takes, by presets and by the hook's filter, and lists of files to look at."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakdrift.functions import library as L
from leakdrift.functions import text as T

# Extensions that the presets take, suffixes and patterns that the hook leaves out.
SOURCE = [
    "rs", "py", "js", "ts", "go", "java", "c", "cpp", "h", "hpp", "cs", "php", "rb", "swift", "kt", "scala", "json", "yaml", "yml", "toml", "ini",
    "cfg", "conf", "config", "env", "sh", "bash", "zsh", "ps1", "bat", "cmd",
]
CONFIGURATION = ["env", "json", "yaml", "yml", "toml", "ini", "cfg", "conf", "config", "properties"]
BINARY_SUFFIXES = [
    ".exe", ".dll", ".so", ".dylib", ".a", ".o", ".obj", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".mp3", ".mp4", ".avi", ".mov", ".wmv",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]
HOOK_EXCLUDED = ["*.test.js", "*.spec.ts", "test/**", "tests/**", "*.md"]


@dataclass(frozen=True)
class ScanConfig:
    """Extensions to take (none: all) and to leave out, parts of paths to leave out, and whether hidden files are taken."""

    included: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=lambda: list(L.EXCLUDED_EXTENSIONS))
    parts: list[str] = field(default_factory=lambda: list(L.EXCLUDED_PARTS))
    largest: int = L.MAX_FILE_BYTES
    hidden: bool = False


SOURCE_CODE, CONFIG_FILES, ALL_FILES = ScanConfig(SOURCE), ScanConfig(CONFIGURATION, hidden=True), ScanConfig(excluded=[])


def skip_reason(path: Column, size: Column, config: ScanConfig = ScanConfig(), regular: Column | None = None) -> Column:  # noqa: B008
    """Why a file is left out; null where it is scanned. A file without an extension is on no list."""
    ext = T.extension(path)
    has = F.substring_index(path, "/", -1).rlike(r"^.+\.[^.]*$")
    out = F.when(size > config.largest, F.concat(F.lit("File too large: "), size.cast("string"), F.lit(" bytes")))
    if regular is not None:
        out = out.when(~regular, "Not a regular file")
    if config.included:
        out = out.when(has & ~ext.isin(config.included), F.concat(F.lit("Extension not in include list: "), ext))
    if config.excluded:
        out = out.when(has & ext.isin(config.excluded), F.concat(F.lit("Extension in exclude list: "), ext))
    for part in config.parts:
        out = out.when(F.lower(path).contains(part.lower()), f"Path contains excluded component: {part}")
    return out


def hook_matches(path: Column, pattern: str) -> Column:
    """`a**b` by beginning and end, `*.x` by end, everything else anywhere."""
    if pattern.count("**") == 1:
        start, end = pattern.split("**")
        return path.startswith(start) & path.endswith(end)
    return path.endswith(pattern[1:]) if pattern.startswith("*.") else path.contains(pattern)


def hook_takes(path: Column, excluded: list[str] = HOOK_EXCLUDED) -> Column:
    """Whether the hook looks at a file."""
    left = F.lit(False)
    for suffix in BINARY_SUFFIXES:
        left = left | path.endswith(suffix)
    for pattern in excluded:
        left = left | hook_matches(path, pattern)
    return ~left


def search(files: DataFrame, query: str, hidden: bool = True) -> DataFrame:
    """files (file_path, more) with the query in the path in any case; an empty query takes all. Hidden by the name's dot."""
    path = F.col("file_path")
    rows = files.where(F.lower(path).contains(query.lower())) if query else files
    return rows if hidden else rows.where(~F.substring_index(path, "/", -1).startswith("."))


#: What comes first behind the folders, by mode.
ORDERS = {
    "name": lambda: [F.lower(F.substring_index("file_path", "/", -1))], "size": lambda: [F.desc("size")], "modified": lambda: [F.desc("modified")],
    "type": lambda: [T.extension(F.col("file_path"))], "encrypted": lambda: [F.desc("is_encrypted")],
}


def listed(files: DataFrame, mode: str, most: int | None = None) -> DataFrame:
    """files (file_path, is_directory, size, modified, is_encrypted, more) in order, folders first; ties by path."""
    rows = files.orderBy(F.desc("is_directory"), *ORDERS[mode](), "file_path")
    return rows if most is None else rows.limit(most)


def with_secrets(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with `has_secrets`: whether the file has a finding, however many."""
    some = found.select("file_path").distinct().withColumn("_s", F.lit(True))
    return files.join(some, "file_path", "left").withColumn("has_secrets", F.coalesce("_s", F.lit(False))).drop("_s")
