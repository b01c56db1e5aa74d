"""Checks of user input as Column expressions: arrays of (field, message, severity), cleaned texts, encrypted paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "array<struct<field:string,message:string,severity:string>>"
# Parts of weak passwords, and the lengths that are too short and too long.
WEAK = ["password", "12345678", "qwerty123", "admin123"]
LONGEST_PATH = 4096
# What a path and a password of enough characters look like, and keys of settings.
PATH_CHARACTERS = r"\A[^<>:|?*\x00-\x1f]*\z"
PASSWORD = r"\A[^\n]{8,}\z"
CONFIG_KEY = r"\A[a-zA-Z0-9_.]+\z"


# Settings with their least and largest numbers and what is said beyond; and the longest other value.
LIMITS = [
    ("memory_cost", "Memory cost", 1024, "Memory cost too low for security", 1048576, "Memory cost extremely high - may cause system issues"),
    ("time_cost", "Time cost", 1, "Time cost must be at least 1", 100, "Time cost very high - operations will be slow"),
    ("parallelism", "Parallelism", 1, "Parallelism must be at least 1", None, ""),
]
LONGEST_VALUE = 1000


def errors(field: str, found: list[tuple[Column, str, str]]) -> Column:
    """The errors whose condition holds, in their order."""
    some = [F.when(c, F.struct(F.lit(field).alias("field"), F.lit(m).alias("message"), F.lit(s).alias("severity"))) for c, m, s in found]
    return F.array_compact(F.array(*some)).cast(ERROR)


def strength(password: Column) -> Column:
    """How many of upper case, lower case, digits and other characters there are; 0 for null and empty."""
    kinds = [r"\p{Lu}", r"\p{Ll}", r"\p{N}", r"[^\p{IsAlphabetic}\p{N}]"]
    return F.coalesce(reduce(lambda a, b: a + b, [password.rlike(k).cast("int") for k in kinds]), F.lit(0))


def password_errors(password: Column) -> Column:
    """Too short is critical; weak parts and fewer than four kinds of characters are warnings. Null is empty."""
    p = F.coalesce(password, F.lit(""))
    weak = reduce(lambda a, b: a | b, [F.lower(p).contains(w) for w in WEAK])
    return errors(
        "password",
        [
            (~p.rlike(PASSWORD), "Password must be at least 8 characters long", "Critical"),
            (weak, "Password appears to contain common weak patterns", "Warning"),
            (strength(p) <= 1, "Password is very weak", "Warning"),
            (strength(p) == 2, "Password is weak - consider adding more character types", "Warning"),
            (strength(p) == 3, "Password is moderate strength", "Warning"),
        ],
    )


def path_errors(path: Column) -> Column:
    """An empty path, steps upwards, characters that paths can't have, and too long ones; all critical. Null is empty."""
    p = F.coalesce(path, F.lit(""))
    some = errors(
        "path",
        [
            (p.contains(".."), "Path traversal detected (..)", "Critical"),
            (~p.rlike(PATH_CHARACTERS), "Path contains invalid characters", "Critical"),
            (F.octet_length(p) > LONGEST_PATH, "Path too long (max 4096 characters)", "Critical"),
        ],
    )
    return F.when(p == "", errors("path", [(F.lit(True), "File path cannot be empty", "Critical")])).otherwise(some)


def config_errors(pair: Column, cpus: int = 8) -> Column:
    """Errors of a setting `key=value`: the form, the key's characters, and what the known keys' values must be. Null is empty."""
    p = F.coalesce(pair, F.lit(""))
    key, value = F.substring_index(p, "=", 1), F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1)
    n = F.when(value.rlike(r"\A\+?0*[0-9]{1,10}\z"), value.try_cast("decimal(38,0)").cast("long"))
    n = F.when(n <= 2**32 - 1, n)
    found = [(~key.rlike(CONFIG_KEY), "config_key", "Configuration key contains invalid characters", "Critical")]
    for name, label, low, least, high, most in LIMITS:
        own = key == name
        found += [(own & n.isNull(), name, f"{label} must be a valid number", "Critical"), (own & (n < low), name, least, "Critical")]
        if high is not None:
            found.append((own & (n > high), name, most, "Warning"))
    own = (key == "parallelism") & (n > 2 * cpus)
    told = F.concat(F.lit("Parallelism ("), n.cast("string"), F.lit(f") higher than recommended ({cpus})"))
    known = key.isin(*[x[0] for x in LIMITS])
    some = [F.when(c, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"), F.lit(s).alias("severity"))) for c, f, m, s in found]
    some.append(F.when(own, F.struct(F.lit("parallelism").alias("field"), told.alias("message"), F.lit("Warning").alias("severity"))))
    some.append(F.when(~known & (F.octet_length(value) > LONGEST_VALUE), F.struct(key.alias("field"), F.lit("Configuration value too long").alias("message"), F.lit("Warning").alias("severity"))))
    none = errors("config", [(F.lit(True), "Invalid config format, expected key=value", "Critical")])
    return F.when(p.contains("="), F.array_compact(F.array(*some)).cast(ERROR)).otherwise(none)


def permissions(mode: Column, folder: Column) -> Column:
    """The ten letters of a file's mode bits."""
    letters = [F.when(mode.bitwiseAND(F.lit(1 << (8 - k))) != 0, "rwx"[k % 3]).otherwise("-") for k in range(9)]
    return F.concat(F.when(folder, "d").otherwise("-"), *letters)


def is_valid(found: Column) -> Column:
    return ~F.exists(found, lambda e: e["severity"] == "Critical")


def rollup(rows: DataFrame, found: str) -> DataFrame:
    """Rows with an array of errors to (field, severity, n); counts are pre-aggregated."""
    # Of an outer generator no condition on the errors is derived, which would be worked out for all rows before they are made distinct.
    rows = rows.select(F.explode_outer(found).alias("e")).where("e is not null")
    return rows.groupBy("e.field", "e.severity").agg(F.count("*").alias("n"))


def sanitized(text: Column) -> Column:
    """Without control characters but newlines and tabs, and without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", ""), r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def encrypted_path(path: Column) -> Column:
    """name.ext to name.ext.enc; a name without extension gets .dat.enc."""
    return F.concat(path, F.when(file_name(path).rlike(r"^.+\.[^.]*$"), ".enc").otherwise(".dat.enc"))


def is_encrypted(path: Column) -> Column:
    return file_name(path).rlike(r"^.+\.enc$")


def decrypted_path(path: Column) -> Column:
    """Without .enc; any other extension is replaced by, and a name without one gets, .decrypted."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.when(is_encrypted(path), stem).otherwise(F.concat(stem, F.lit(".decrypted")))


def flat_path(path: Column) -> Column:
    return F.translate(path, "/\\", "__")
