"""The pattern library and the word lists of the confidence model, with each secret type's severity."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SecretPattern:
    name: str
    regex: str
    secret_type: str
    confidence: float
    #: Lower-case strings of which a text with a match holds one; none: every text is searched.
    needs: tuple[str, ...] = ()


# The built-in patterns, in their order of precedence.
PATTERNS = [
    SecretPattern("AWS Access Key ID", r"(?i)(AKIA[0-9A-Z]{16})", "AWS Access Key", 0.95, ("akia",)),
    SecretPattern("AWS Secret Access Key", r"(?i)(aws_secret_access_key|aws_secret_key)\s*[:=]\s*([A-Za-z0-9/+=]{40})", "AWS Secret Key", 0.90, ("aws_secret",)),
    SecretPattern("AWS Session Token", r"(?i)(aws_session_token)\s*[:=]\s*([A-Za-z0-9/+=]{100,})", "AWS Session Token", 0.85, ("aws_session_token",)),
    SecretPattern("GitHub Personal Access Token", r"(?i)gh[pousr]_[A-Za-z0-9_]{36,255}", "GitHub Personal Access Token", 0.95, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretPattern("GitHub Classic Token", r"(?i)[a-f0-9]{40}", "GitHub Personal Access Token", 0.70),
    SecretPattern("SSH Private Key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "SSH Private Key", 0.98, ("-----begin ",)),
    SecretPattern("SSH Public Key", r"ssh-(?:rsa|dss|ed25519|ecdsa) [A-Za-z0-9+/]+=?", "SSH Public Key", 0.80, ("ssh-",)),
    SecretPattern("PostgreSQL URL", r"postgres(?:ql)?://[^\s]+", "PostgreSQL URL", 0.90, ("postgres",)),
    SecretPattern("MySQL URL", r"mysql://[^\s]+", "MySQL URL", 0.90, ("mysql://",)),
    SecretPattern("MongoDB URL", r"mongodb(?:\+srv)?://[^\s]+", "MongoDB URL", 0.90, ("mongodb",)),
    SecretPattern("Redis URL", r"redis://[^\s]+", "Redis URL", 0.85, ("redis://",)),
    SecretPattern("Stripe API Key", r"(?i)(sk|pk|rk)_(test|live)_[a-zA-Z0-9]{10,99}", "Stripe API Key", 0.95, ("_test_", "_live_")),
    SecretPattern("SendGrid API Key", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", "SendGrid API Key", 0.95, ("sg.",)),
    SecretPattern("Twilio API Key", r"SK[a-f0-9]{32}", "Twilio API Key", 0.90, ("sk",)),
    SecretPattern("Slack Token", r"xox[baprs]-[0-9]{12}-[0-9]{12}-[a-zA-Z0-9]{24}", "Slack Token", 0.95, ("xox",)),
    SecretPattern("JWT", r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", "JWT Token", 0.80, ("eyj",)),
    SecretPattern("Bearer Token", r"(?i)bearer\s+[A-Za-z0-9\-\._~\+\/]+=*", "Bearer Token", 0.70, ("bearer",)),
    SecretPattern("RSA Private Key", r"-----BEGIN RSA PRIVATE KEY-----", "RSA Private Key", 0.98, ("-----begin rsa",)),
    SecretPattern("EC Private Key", r"-----BEGIN EC PRIVATE KEY-----", "EC Private Key", 0.98, ("-----begin ec",)),
    SecretPattern("PGP Private Key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----", "PGP Private Key", 0.98, ("-----begin pgp",)),
    SecretPattern("Environment Secret", r"(?i)(api_key|secret|password|token|auth|credential)\s*[:=]\s*[A-Za-z0-9/+=]{8,}", "Environment Secret", 0.60, ("api_key", "secret", "password", "token", "auth", "credential")),
]

# Words near a pattern's match that speak for it, and words near or in it that speak against it, by name;
# and words in any match that do.
CONTEXT_WORDS = {
    "AWS Access Key ID": ["aws", "amazon", "access", "key"],
    "AWS Secret Access Key": ["secret", "aws"],
    "GitHub Personal Access Token": ["github", "token", "pat"],
    "GitHub Classic Token": ["github", "token", "oauth"],
}
IGNORE_WORDS = {"Environment Secret": ["example", "test", "placeholder", "your_", "my_"]}
NO_SECRET_WORDS = ["example", "sample", "test", "placeholder", "dummy"]

# Severity of each type of the library; every other type has 5.
SEVERITY = {
    "AWS Access Key": 10, "AWS Secret Key": 10, "AWS Session Token": 10, "GitHub Personal Access Token": 9,
    "SSH Private Key": 9, "RSA Private Key": 9, "EC Private Key": 9, "PostgreSQL URL": 9, "MySQL URL": 9,
    "Stripe API Key": 8, "SendGrid API Key": 8, "Twilio API Key": 8, "PGP Private Key": 8, "Slack Token": 7,
    "JWT Token": 6, "Bearer Token": 6, "MongoDB URL": 5, "Redis URL": 5, "Environment Secret": 5, "SSH Public Key": 3,
}

# Words that say a text is a test, or a configuration.
TEST_WORDS = ["test", "example", "sample", "placeholder", "dummy", "fake", "mock", "demo", "todo", "fixme", "changeme"]
CONFIG_WORDS = ["config", "settings", "env", "environment", "production", "prod", "staging", "live", "secret", "key", "token", "password"]
# Parts of values that are no secrets.
FALSE_PARTS = [
    "aaaaaaa", "bbbbbbb", "1234567", "abcdefg", "qwertyu", "password", "12345678", "87654321", "00000000", "11111111",
    "ffffffff", "deadbeef", "cafebabe", "test1234", "admin123", "user1234",
]
# Words that make a value prose.
COMMON_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "was", "one", "our", "out", "day", "get", "has", "him", "his",
    "how", "its", "may", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "man", "car", "dog", "cat", "run",
]
# Parts of common values that are no secrets.
NON_SECRETS = [
    "localhost", "127.0.0.1", "example.com", "test.com", "placeholder", "your_key_here", "insert_key_here", "todo",
    "fixme", "changeme", "password123", "abcdefgh", "12345678", "qwertyui",
]
# Expressions of values that post-processing leaves out.
IGNORED_VALUES = ["example", "test", "placeholder", "your_.*_here", "insert_.*_here", "12345", "password123", "changeme", "dummy", "fake"]
# What the walk leaves out.
EXCLUDED_EXTENSIONS = [
    "exe", "dll", "so", "dylib", "bin", "obj", "lib", "a", "png", "jpg", "jpeg", "gif", "bmp", "svg", "ico", "mp4", "avi", "mov", "wmv",
    "zip", "tar", "gz", "rar", "7z", "bz2", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
]
# Parts of paths that the walk leaves out.
EXCLUDED_PARTS = ["node_modules", "target", ".git", ".svn", ".hg", "build", "dist", "vendor", ".cargo"]
MAX_FILE_BYTES = 10 * 1024 * 1024
# Extensions that raise, keep and lower a finding's confidence.
CONFIG_EXTENSIONS = ["env", "config", "conf", "ini", "toml", "yaml", "yml"]
SOURCE_EXTENSIONS = ["rs", "py", "js", "go", "java", "php", "rb"]
DOC_EXTENSIONS = ["md", "txt", "rst", "doc"]
# Keyword, what follows it, and the least length and character classes that it asks for.
CONTEXTUAL = {
    "password": r"""[^"'\s]{8,}""",
    "api_key": r"[A-Za-z0-9_\-]{20,}",
    "secret": r"[A-Za-z0-9_\-]{12,}",
    "token": r"[A-Za-z0-9_\-]{20,}",
    "auth": r"[A-Za-z0-9_\-]{16,}",
    "credential": r"""[^"'\s]{10,}""",
    "private_key": r"[A-Za-z0-9+/=]{40,}",
}
# Words that say what to fill in.
HELP_WORDS = ["your", "my", "insert", "replace", "change", "enter", "here"]
# The commit hook's patterns, applied to each line.
HOOK_PATTERNS = {
    "api_key": r"(?i)api[_-]?key\s*[:=]\s*[a-zA-Z0-9]{16,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN (RSA |EC |)PRIVATE KEY-----",
    "password": r"(?i)password\s*[:=]\s*[^\s]{8,}",
    "token": r"(?i)token\s*[:=]\s*[a-zA-Z0-9]{20,}",
    "secret": r"(?i)secret\s*[:=]\s*[a-zA-Z0-9]{16,}",
}
# Warnings on a text as a whole.
WARNINGS = {
    "Potential password": r"(?i)password\s*[=:]\s*[\w@#$%^&*!]+",
    "Potential API key": r"(?i)api[_-]?key\s*[=:]\s*[\w-]+",
    "Potential secret key": r"(?i)secret[_-]?key\s*[=:]\s*[\w-]+",
    "Potential AWS access key": r"AKIA[0-9A-Z]{16}",
    "Potential Stripe secret key": r"sk_live_[0-9a-zA-Z]{24,}",
    "Potential GitHub personal access token": r"ghp_[0-9a-zA-Z]{36}",
}
# Warnings on a file as a whole, the size from which there is one, and parts of names.
MAX_CHECKED_BYTES = 100 * 1024 * 1024
TOO_LARGE = "File too large for encryption (>100MB)"
BINARY = "File appears to be binary - ensure this is intended"
ENCODED = "High entropy string detected - may be encoded secret"
SUSPICIOUS = "Filename suggests this file may contain sensitive data"
SUSPICIOUS_NAMES = ["password", "secret", "key", "token", "credential"]
