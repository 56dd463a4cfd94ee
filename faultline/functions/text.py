"""Line-wise text expressions over whole log texts and source files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Shape of a log line header, [time+0000] {file:line} LEVEL - message.
HEADER = r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3})\+0000\] \{([^:}]+):(\d+)\} ([A-Z]+) - "
HEADER_AHEAD = r"\n(?=\[\d{4}-\d{2}-\d{2}T[^\]\n]*\] \{)"

# Figures a log may state. Each pattern has one group; the literal
# before it occurs in every match, so texts without it skip the pattern.
SIGNALS: dict[str, tuple[str, str]] = {
    "exit_code": ("exit code", r"exit code:? (\d+)"),
    "rss_mib": ("Current RSS", r"Current RSS: (\d+)MiB"),
    "peak_rss_mib": ("Peak container", r"Peak container memory RSS: (\d+)MiB"),
    "utilization_pct": ("utilization", r"utilization: ([\d.]+)%"),
    "model_index": ("Model ", r"Model (\d+)/\d+"),
    "model_total": ("Model ", r"Model \d+/(\d+)"),
    "model_seconds": ("completed in", r"completed in ([\d.]+)s"),
    "duplicate_keys": ("duplicate keys", r"(\d+) duplicate keys found"),
    "rows_received": ("received", r"received ([\d,]+) rows"),
    "rows_baseline": ("baseline", r"baseline: ([\d,]+)"),
    "rows_tolerance": ("+/-", r"\+/- ([\d,]+)"),
    "retry_after_s": ("Retry-After", r"Retry-After'?: '?(\d+)"),
    "clock_drift_s": ("drifted by", r"drifted by (\d+) seconds"),
    "disk_used_gi": ("usage", r"usage ([\d.]+)Gi"),
    "disk_limit_gi": ("exceeded limit", r"exceeded limit ([\d.]+)Gi"),
    "max_connections": ("max_connections", r"max_connections=(\d+)"),
    "active_tasks": ("tasks connected", r"(\d+) (?:Airflow )?worker tasks connected"),
    "statement_timeout_ms": ("ms exceeded", r"\((\d+)ms exceeded\)"),
}

# Words that announce a credential. A name may hold one at its end, or before a separator; in mixed case too.
_WORD = r"(?:token|passw(?:or)?d|passphrase|pwd|secret|(?:api|access|private|signing|encryption)[_-]?key|credentials?)"
_NAMED = rf"(?<![A-Za-z0-9_.-])(?:[A-Za-z0-9_.-]*?{_WORD}(?:[_.-][A-Za-z0-9_.-]*)?)"
_VALUE = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|[^\s,;&}\"']+"

# A line without one of these, in any case, holds no credential.
HINTS = (
    "token", "passw", "passphrase", "pwd", "secret", "key", "credential", "authorization", "bearer", "cookie", "://", "akia",
    "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "xox", "glpat-", "eyj", "_live_", "_test_", "aiza", "npm_",
)
GOES_ON = "\x0b\x0c\x0b"
PRIVATE_KEY = (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)(?s:.*?)(-----END [A-Z ]*PRIVATE KEY-----|\z)", "$1***$2")

# Credentials on a line, as (pattern, replacement), one after the other.
CREDENTIALS: tuple[tuple[str, str], ...] = (
    (r"(?i)((?:set-)?cookie[\"']\s*[=:]\s*)(?:(\")[^\"\n]*\"|(')[^'\n]*')", "$1$2$3***$2$3"),
    (r"(?i)((?<![A-Za-z0-9])(?:set-)?cookie:\s*)[^\n\"']+", "$1***"),
    (
        r"(?i)(authorization[\"']?\s*[=:]\s*[\"']?(?:basic|token|digest|apikey)\s+|(?<![A-Za-z0-9_])bearer\s+)[A-Za-z0-9._~+/=-]+",
        "$1***",
    ),
    # Tokens known by their shape.
    (
        r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:gh[opsur]_|github_pat_)[A-Za-z0-9_]{8,}|xox[abeoprs]-[A-Za-z0-9-]{8,}"
        r"|glpat-[A-Za-z0-9_-]{8,}|[sr]k_(?:live|test)_[A-Za-z0-9]{8,}|AIza[0-9A-Za-z_-]{30,}|npm_[A-Za-z0-9]{20,}"
        r"|eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?)",
        "***",
    ),
    # After a quoted name, as in JSON, the quotes of the value stay.
    (
        rf"(?i)({_NAMED}[\"']\s*[=:]\s*)(?:(\")(?:[^\"\\\n]++|\\.)*+\"|(')(?:[^'\\\n]++|\\.)*+'|[^\s,;&}}\"']+)",
        "$1$2$3***$2$3",
    ),
    (rf"(?i)({_NAMED}\s*[=:]\s*)(?:{_VALUE})", "$1***"),
    # An option and its value, with a blank between them.
    (rf"(?i)((?<![A-Za-z0-9_.-])--?[A-Za-z0-9_.-]*?{_WORD}\s+)(?!-)(?:{_VALUE})", "$1***"),
    (r"(://[^\s:/@]*):[^\s@/]+@", "$1:***@"),
    (r"(https://hooks\.[A-Za-z0-9.-]+/)[^\s\"'<>]+", "$1***"),
)

BLANKS = " \t\n\r\f\x0b"


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no empty line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def lines_with_ends(text: Column) -> Column:
    """Lines that keep their ends, so joining them gives the text back."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda line: line != "")


def last_items(items: Column, n: int) -> Column:
    # Reversing twice names ``items`` once, so it is computed once.
    return F.reverse(F.slice(F.reverse(items), 1, n))


def tail(text: Column, n: int) -> Column:
    """The last ``n`` lines as text."""
    return F.array_join(last_items(lines_with_ends(text), n), "")


def preview(text: Column, chars: int = 800) -> Column:
    """The first ``chars`` characters, as shown to a person who decides on a change."""
    return F.substring(text, 1, chars)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def evidence(text: Column, keep: int = 6, within: int = 40) -> Column:
    """The last ``keep`` non-blank lines of the last ``within`` lines, stripped."""
    stripped = F.transform(last_items(F.split(strip(text), "\n"), within), strip)
    return last_items(F.filter(stripped, lambda line: line != ""), keep)


def masked(text: Column) -> Column:
    """A text without the values of its credentials.

    Only lines that hold a hint are rewritten. A line that ends in ``=`` or ``:`` goes on in the next one.
    """

    def one(line: Column, lowered: Column) -> Column:
        out = line
        for pattern, replacement in CREDENTIALS:
            out = F.regexp_replace(out, pattern, replacement)
        hinted = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(hint)) for hint in HINTS))
        return F.when(hinted, out).otherwise(line)

    bare = F.when(F.contains(text, F.lit("PRIVATE KEY-----")), F.regexp_replace(text, *PRIVATE_KEY)).otherwise(text)
    # Blanks stand for the ends of lines that go on, so that lines can be told apart by their ends alone.
    joined = F.regexp_replace(bare, r"([=:][ \t]*)\n", f"$1{GOES_ON}")
    lines_of, lowered = F.split(joined, "\n"), F.split(F.lower(joined), "\n")
    return F.replace(F.array_join(F.zip_with(lines_of, lowered, one), "\n"), F.lit(GOES_ON), F.lit("\n"))


def numbers(text: Column, signal: str) -> Column:
    """All values of one signal in the text, in order."""
    literal, pattern = SIGNALS[signal]
    found = F.when(
        F.contains(text, F.lit(literal)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double"))
