"""Predicates and extractions over commit messages, comments, paths and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message formats.
CONVENTIONAL = r"^([a-zA-Z]+)(?:\(([^)]+)\))?(!)?:\s+(.+)"
TICKET = r"\b([A-Z]{2,10}-\d+)\b"
TICKET_PREFIX = r"^([A-Z]{2,10}-\d+)[:\s]+(.+)"
BRACKET = r"^\[([^\]]+)\]\s*(.+)"
GITMOJI = r"^([\x{1f300}-\x{1faff}]|:\w+:)\s*(.+)"
REVERT_SUBJECT = r'(?i)^Revert ".*"'
REVERT_HASH = r"(?i)This reverts commit ([0-9a-f]{7,40})"
BREAKING = r"(?m)^BREAKING[ -]CHANGE:\s*(.+)"
MARKER = r"^(?:fixup|squash|amend)!\s+"

# Commit types by conventional type, and by emoji code.
TYPES = {
    "feat": "feat", "fix": "fix", "refactor": "refactor", "test": "test", "tests": "test", "docs": "docs", "doc": "docs",
    "ci": "ci", "build": "build", "chore": "chore", "style": "style", "perf": "perf", "revert": "revert", "merge": "merge",
}
EMOJI_TYPES = {
    ":sparkles:": "feat", ":bug:": "fix", ":recycle:": "refactor", ":white_check_mark:": "test", ":memo:": "docs", ":construction_worker:": "ci", ":wrench:": "chore",
    ":art:": "style", ":zap:": "perf", ":rewind:": "revert", ":fire:": "chore", ":lipstick:": "style", ":rotating_light:": "fix", ":rocket:": "feat", ":package:": "build",
    ":heavy_plus_sign:": "build", ":heavy_minus_sign:": "build", ":lock:": "fix", ":bookmark:": "chore",
}

# Kinds of files.
TEST_PATH = r"(?i)(test_|_test\.|\.test\.|tests/|test/|spec_|_spec\.|\.spec\.|specs/|spec/|__tests__/|testing/)"
DOC_PATH = r"(\.(md|rst|txt|adoc)$|^docs/|^doc/|^documentation/)"
CI_PATH = r"(\.github/workflows/|\.gitlab-ci|Jenkinsfile|\.circleci/|\.travis\.yml|azure-pipelines|\.buildkite/)"
CONFIG_PATH = r"(\.(toml|yaml|yml|json|ini|cfg|conf)$|\.gitignore|\.eslintrc|\.prettierrc|Makefile|Dockerfile|docker-compose)"

# Words and forms of corrections.
FOLLOWUP = r"fix|oops|typo|forgot|actually|woops|mistake|correct|amend|patch|broken|missed"
STRONG_FIX = r"(?i)(fix(?:es|ed)?\s+(?:bug|issue|error|crash|regression)|\brevert\b|\bhotfix\b)"

# Comments that say nothing, and authors that are machines.
PRAISE = r"(?i)^\s*(lgtm!?|looks?\s+good(\s+to\s+me)?!?|\+1|:?\+1:?|ship\s+it!?|approved?!?|nice!?|great!?)\s*$"
MACHINE_TEXT = r"(?i)^\s*(### Changes\s*```|This branch currently is behind|<!-- Sti|Coverage Report|## Coverage)"
MACHINE_AUTHORS = ("github-actions", "github-actions[bot]", "dependabot", "dependabot[bot]", "renovate", "renovate[bot]", "codecov", "codecov[bot]")
LEAST_COMMENT = 20

# Lines that run something.
COMMAND = r"(?im)^\s*(?:uv|python|pytest|ruff|mypy|npm|pnpm|yarn|make|just)\b.*$"
HEADING = r"(?m)^#{1,3}\s+(.+)$"
TOKEN = r"[a-zA-Z0-9_/.\-]+"


def matched(column: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def stripped(column: Column) -> Column:
    """Without white space and control separators at both ends."""
    return F.regexp_replace(column, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def ticket(text: Column) -> Column:
    """The first ticket, or the first issue number."""
    issue = matched(text, r"#(\d+)")
    return F.coalesce(matched(text, TICKET), F.when(issue.isNotNull(), F.concat(F.lit("#"), issue)))


def mapped(column: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]
    return F.coalesce(out, F.lit(default)) if default is not None else out


def is_revert(subject: Column, body: Column) -> Column:
    return subject.rlike(r'(?i)^Revert "(.+)"') | body.rlike(REVERT_HASH)


def is_trivial(body: Column) -> Column:
    """Too short, mere praise, or written by a machine."""
    plain = stripped(body)
    return (F.length(plain) < LEAST_COMMENT) | plain.rlike(PRAISE) | plain.rlike(MACHINE_TEXT)


def is_machine(author: Column) -> Column:
    return F.lower(author).isin(*MACHINE_AUTHORS)


def is_imperative(subject: Column) -> Column:
    """Whether the first word, after a colon if text follows it, has no ending of a past or running action."""
    after = F.trim(F.regexp_extract(subject, r"^[^:]*:(.*)$", 1))
    text = F.when(after != "", after).otherwise(F.trim(subject))
    word = F.regexp_replace(F.lower(F.regexp_extract(text, r"^(\S+)", 1)), ":+$", "")
    return (word != "") & ~word.rlike("(ed|ing)$")


def tokens(text: Column) -> Column:
    """Distinct lower-case path-like tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def words(text: Column) -> Column:
    """Lower-case words without accents, one blank between them and at both ends: for phrase search."""
    plain = F.translate(F.lower(text), "äáàâãåéèêëíìîïöóòôõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
