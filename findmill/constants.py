"""Fixed values that results depend on. Nothing here is computed."""

# Severity domain, in rank order.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4, "none": 5}
SEVERITY_SYNONYMS = {
    "critical": "critical",
    "high": "high",
    "error": "high",
    "medium": "medium",
    "moderate": "medium",
    "warning": "medium",
    "low": "low",
    "info": "info",
    "informational": "info",
    "note": "info",
    "unknown": "info",
}
DEFAULT_SEVERITY = "low"

FINDING_STATUSES = ("new", "triaged", "fixed", "false_positive", "accepted_risk")
ENGINE_STATES = ("skipped", "unavailable", "running", "done", "failed")
TERMINAL_SCAN_STATUSES = ("succeeded", "failed", "aborted")

# Failure kinds that turn a scan into a failed scan.
REAL_FAILURE_KINDS = ("timeout", "execution", "malformed_output", "rule_config")

ENGINE_SOURCE_TYPE = {
    "bandit": "sast",
    "opengrep": "sast",
    "trivy": "sca",
    "gitleaks": "secrets",
    "zap": "dast",
}
DEFAULT_ENGINES = {
    "full": ("bandit", "opengrep", "trivy", "gitleaks"),
    "dast": ("zap",),
    "sca": ("trivy",),
    "secrets": ("gitleaks",),
}
SAST_ENGINES = ("bandit", "opengrep")
UPLOAD_PRESETS = {
    "full": ("full", ("bandit", "opengrep", "trivy", "gitleaks")),
    "sast": ("sast", ("bandit", "opengrep")),
    "dependencies": ("sca", ("trivy",)),
    "secrets": ("secrets", ("gitleaks",)),
}
ENGINE_COMPAT = {
    "full": ("bandit", "opengrep", "trivy", "gitleaks"),
    "sast": ("bandit", "opengrep"),
    "sca": ("trivy",),
    "secrets": ("gitleaks",),
}
ZAP_RISK_SEVERITY = {0: "info", 1: "low", 2: "medium", 3: "high"}

# Redaction.
REDACTED = "[REDACTED]"
MIN_TOKEN_LENGTH = 4
CREDENTIAL_PATTERNS = {
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "live-secret-key": r"\bsk_live_[0-9A-Za-z]{16,}\b",
    "live-public-key": r"\bpk_live_[0-9A-Za-z]{16,}\b",
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned-credential": (
        r"(?i)\b(api[_-]?key|secret|token|password|passwd|authorization)\b"
        r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-./+=]{8,})"
    ),
}

# Source context.
CONTEXT_BEFORE = 4
CONTEXT_AFTER = 4
MAX_CONTEXT_LINES = 25
MAX_CONTEXT_BYTES = 8 * 1024
LINE_TRUNCATED = "[line truncated]"
SNIPPET_CHARS = 2000
SNIPPET_LINES = 40
FINGERPRINT_SNIPPET_CHARS = 200
EVIDENCE_VERSION = 1

# Event buffer.
EVENT_RING_SIZE = 2000

# Archive limits.
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
MAX_EXPANDED_BYTES = 500 * 1024 * 1024
MAX_ARCHIVE_FILES = 20000
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_COMPRESSION_RATIO = 100

# File suffix -> language.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".pyi": "python",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".go": "go",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".tf": "hcl",
    ".json": "json",
    ".html": "html",
    ".xml": "xml",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "cpp",
    ".sh": "bash",
    ".swift": "swift",
    ".vue": "vue",
}
LANGUAGE_PRIORITY = {"python": 0, "java": 1, "javascript": 2, "typescript": 3, "kotlin": 4, "go": 5}
RULE_LANGUAGES = ("python", "java", "javascript", "typescript", "kotlin", "go", "yaml", "hcl", "json")

TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")

# Messages.
RECOVERY_MESSAGE = "scan interrupted by service restart"
VERDICT_ENGINE_FAILED = "one or more scanners failed; see engine coverage for details"
VERDICT_NONE_COMPLETED = "no scanner completed successfully; refusing to report an empty result"
LEAK_REMEDIATION = (
    "Rotate the leaked secret and remove it from source. Use CI/CD secrets or a vault."
)
RETRY_FAILED_MESSAGE = " offline fallback also failed: "
DEGRADED_MESSAGE = (
    "Maven Central rate-limited dependency enrichment; completed one "
    "offline Trivy fallback with reduced dependency coverage."
)

# Python's str.splitlines() separators and str.strip() whitespace, as Java regex.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE_CLASS = r"[\s\x1c-\x1f]"
# The same white space character by character.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Messages of rule packs and their manifest.
RULES_NOT_LISTED = "top-level rules must be a list"
MANIFEST_UNSOUND = "manifest must have version: 1 and a non-empty sources list"
