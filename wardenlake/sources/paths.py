"""Path-safety audit: which rules a path breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardenlake.sources.corpus import file_name

# Character rules, length limit, extension whitelist, suspicious endings, reserved names.
DANGEROUS = {"parent": "..", "tilde": "~", "dollar": "$", "backtick": "`", "pipe": "|", "semicolon": ";", "ampersand": "&", "nul": "\x00"}
MAX_PATH = 4096
ALLOWED_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".vue", ".html", ".css", ".scss", ".less", ".json", ".yaml", ".yml",
                      ".md", ".txt", ".xml", ".sql", ".sh", ".bash"]
SUSPICIOUS_ENDINGS = [".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar", ".app", ".deb", ".rpm", ".dmg", ".pkg",
                      ".msi", ".dll", ".so", ".dylib"]
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]


def violations(path: Column) -> Column:
    """Rule names that a path breaks; empty means clean."""
    name = file_name(path)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    ending = F.lower(path)
    suspicious = F.lit(False)
    for e in SUSPICIOUS_ENDINGS:
        suspicious = suspicious | ending.endswith(e)
    rules = {
        **{f"contains_{label}": path.contains(mark) for label, mark in DANGEROUS.items()},
        "length": (F.length(path) == 0) | (F.length(path) >= MAX_PATH),
        "extension_not_allowed": (suffix != "") & ~suffix.isin(ALLOWED_EXTENSIONS),
        "suspicious_extension": suspicious,
        "reserved_name": F.upper(F.split_part(name, F.lit("."), F.lit(1))).isin(RESERVED),
        "edge_characters": name.rlike(r"^\s|[\s.]$"),
        "separator_in_name": name.contains("\\"),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
