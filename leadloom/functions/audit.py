"""Line audit: credentials, private paths and personal data."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_B, _E = r"(?:^|[^A-Za-z0-9_])", r"(?:[^A-Za-z0-9_]|$)"
# Fixed values: (severity, rule, pattern) on one line.
RULES = (
    ("error", "aws-access-key", _B + r"AKIA[0-9A-Z]{16}" + _E),
    ("error", "github-token", _B + r"gh[pousr]_[A-Za-z0-9]{20,}" + _E),
    ("error", "slack-token", _B + r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("error", "google-api-key", _B + r"AIza[0-9A-Za-z_-]{35}"),
    ("error", "openai-key", _B + r"sk-(proj-)?[A-Za-z0-9_-]{20,}"),
    ("error", "generic-secret-assignment", r"(?i)" + _B + r"(api[_-]?key|secret|password|passwd|token)[ \t]*[:=][ \t]*['\"]?[A-Za-z0-9+/_-]{16,}"),
    ("error", "private-key-block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("error", "connection-string", r"(?i)" + _B + r"(postgres|mysql|mongodb([+]srv)?|amqp)://[^ '\"]+:[^ '\"]+@"),
    ("error", "windows-user-path", r"[A-Za-z]:\\Users\\[A-Za-z][A-Za-z0-9_.-]*"),
    ("error", "windows-profile-path", r"(?i)[A-Za-z]:\\Documents and Settings\\"),
    ("error", "wsl-user-mount", r"/mnt/c/Users/[A-Za-z][A-Za-z0-9_.-]*"),
    ("error", "home-abs-path", r"(?:^|[^A-Za-z0-9_/])/home/[A-Za-z][A-Za-z0-9_.-]*/"),
    ("warning", "resume-file", r"(?i)" + _B + r"(resume|cv|transcript)[A-Za-z0-9_-]*[.](pdf|docx?)" + _E),
    ("warning", "application-status-language", r"(?i)" + _B + r"(my application (status|outcome)|i applied|interviewed at)" + _E),
)
#: Parts of which each match of a rule of RULES holds one, in lower case; a text or line without any is not looked at further.
_PARTS = {
    "aws-access-key": ("akia",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack-token": ("xox",), "google-api-key": ("aiza",), "openai-key": ("sk-",),
    "generic-secret-assignment": ("apikey", "api_key", "api-key", "secret", "password", "passwd", "token"), "private-key-block": ("private key-----",), "connection-string": ("://",),
    "windows-user-path": (":\\users\\",), "windows-profile-path": ("documents and settings",), "wsl-user-mount": ("/mnt/c/users/",), "home-abs-path": ("/home/",),
    "resume-file": (".pdf", ".doc"), "application-status-language": ("my application", "i applied", "interviewed at"),
}
#: The same by pattern, so another pattern under a known name is never judged by these parts.
IMPLIED = {pattern: _PARTS[rule] for _, rule, pattern in RULES}
# What must not be published, whatever it holds.
BANNED_NAMES = (".env", ".env.local", ".env.production", "id_rsa", "id_ed25519", "id_ecdsa", "credentials.json", "client_secret.json")
BANNED_SUFFIXES = (".sqlite", ".sqlite3", ".db", ".db-journal", ".sqlite-wal", ".sqlite-shm", ".log", ".pem", ".key", ".p12", ".pdf", "-packet.json", "_health.json")
BANNED_FOLDERS = ("node_modules", "__pycache__", ".venv", "venv", "data", "output", "logs")


def line_findings(texts: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """(key, line, severity, rule): one row for each rule that a line breaks. Texts without anything that a rule implies are left out before they are cut."""
    body, low = F.col(text), F.col("__low")
    hint = lambda x, pattern: functools.reduce(operator.or_, (F.contains(x, F.lit(part)) for part in IMPLIED[pattern])) if pattern in IMPLIED else F.lit(True)
    some = functools.reduce(operator.or_, (hint(low, pattern) for _, _, pattern in rules))
    lines = texts.select(key, body.alias("__text"), F.lower(body).alias("__low")).where(some).select(key, F.posexplode(F.split("__text", "\n")).alias("line", "words"))
    lines = lines.withColumn("__low", F.lower("words")).where(some)
    broken = F.array_compact(F.array(*(F.when(hint(low, p) & F.col("words").rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, p in rules)))
    return lines.select(key, (F.col("line") + 1).alias("line"), F.explode(broken).alias("f")).select(key, "line", "f.severity", "f.rule")


def banned_path(path: Column) -> Column:
    """Why a path must not be published, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lit(False)
    for s in BANNED_SUFFIXES:
        suffix = suffix | F.endswith(F.lower(path), F.lit(s))
    return (
        F.when(F.lower(name).isin(*BANNED_NAMES), "banned-filename")
        .when(F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in BANNED_FOLDERS))), "banned-directory")
        .when(suffix, "banned-suffix")
    )
