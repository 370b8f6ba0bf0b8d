"""Patterns of secrets, personal data and noise. Their text is fixed: results depend on it."""

from __future__ import annotations

#: Secrets in contents: id, severity, pattern (Java syntax); group 1 is the secret. In the order in which they are applied.
SECRETS: list[tuple[str, str, str]] = [
    ("github-pat", "critical", r"(ghp_[a-zA-Z0-9]{36})"),
    ("github-oauth", "critical", r"(gho_[a-zA-Z0-9]{36})"),
    ("github-app-token", "critical", r"(ghs_[a-zA-Z0-9]{36})"),
    ("github-refresh-token", "critical", r"(ghr_[a-zA-Z0-9]{36})"),
    ("private-key", "critical", r"(-----BEGIN ((?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY)-----[\s\S]*?-----END \2-----)"),
    ("slack-bot-token", "critical", r"(xoxb-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9]*)"),
    ("slack-user-token", "critical", r"(xoxp-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9]*)"),
    ("stripe-secret", "critical", r"(sk_live_[0-9a-zA-Z]{24,})"),
    ("stripe-restricted", "critical", r"(rk_live_[0-9a-zA-Z]{24,})"),
    ("openai-api-key", "critical", r"(sk-[a-zA-Z0-9_-]{10,})"),
    ("generic-api-key", "high", r"""(?i)(?:api[_-]?key|api[_-]?secret)[\s"'=:]*["']?([a-zA-Z0-9_-]{16,})["']?"""),
    ("database-url-password", "high", r"(?i)(?:postgresql|mysql|mongodb|redis)://[^:\s]+:([^@\s]+)@[^\s]+"),
    ("jwt-token", "high", r"(eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*)"),
    ("bearer-token", "medium", r"(?i)bearer\s+((?=[a-zA-Z0-9_\-.~+/=]*[0-9_\-.~+/=])[a-zA-Z0-9_\-.~+/=]{1,}|[a-zA-Z0-9_\-.~+/=]{12,})"),
    ("basic-auth", "high", r"(?i)basic\s+([a-zA-Z0-9+/=]{4,})"),
    ("auth-token", "high", r"""(?i)(?:auth[_-]?token|access[_-]?token)[\s"'=:]*["']?([a-zA-Z0-9_-]{16,})["']?"""),
    ("password-in-code", "high", r"""(?i)(?:password|passwd|pwd)[\s"'=:]*["']([^"'\s]{8,})["']"""),
    ("secret-in-code", "high", r"""(?i)(?:secret[_-]?key|app[_-]?secret)[\s"'=:]*["']?([a-zA-Z0-9_-]{16,})["']?"""),
]

#: Directories that hold credentials: id, pattern.
SENSITIVE_DIRECTORIES: list[tuple[str, str]] = [("aws-dir", r"(?i)/\.aws/"), ("ssh-dir", r"(?i)/\.ssh/"), ("gnupg-dir", r"(?i)/\.gnupg/"), ("docker-dir", r"(?i)/\.docker/"), ("kube-dir", r"(?i)/\.kube/")]

#: File names of credentials: id, pattern.
SENSITIVE_NAMES: list[tuple[str, str]] = [
    ("dot-env", r"\.env(\.[\w.-]+)?$"),
    ("pem-file", r"(?i)\.pem$"),
    ("key-file", r"(?i)\.key$"),
    ("crt-file", r"(?i)\.crt$"),
    ("p12-file", r"(?i)\.p12$"),
    ("pfx-file", r"(?i)\.pfx$"),
    ("credentials-json", r"(?i)\.credentials\.json$"),
    ("secret-file", r"(?i)\.secret$"),
    ("password-file", r"(?i)\.password$"),
    ("aws-credentials", r"(?i)\.aws/credentials$"),
    ("kubeconfig", r"(?i)kubeconfig$"),
    ("ssh-id-rsa", r"(?i)id_rsa$"),
    ("ssh-id-dsa", r"(?i)id_dsa$"),
    ("ssh-id-ecdsa", r"(?i)id_ecdsa$"),
    ("ssh-id-ed25519", r"(?i)id_ed25519$"),
    ("secret-in-name", r"(?i)secret"),
    ("password-in-name", r"(?i)password"),
    ("credential-in-name", r"(?i)credential"),
    ("private-key-in-name", r"(?i)private[_-]?key"),
    ("access-token-in-name", r"(?i)access[_-]?token"),
    ("api-key-in-name", r"(?i)api[_-]?key"),
]

#: Personal data by type: pattern and placeholder, in the order in which they are tried.
PERSONAL: dict[str, tuple[str, str]] = {
    "cpf": (r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "[CPF]"),
    "cnpj": (r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "[CNPJ]"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    "phone_br": (r"(?:\+55\s?)?(?:\(?[1-9]{2}\)?\s?)?(?:9\d{4}|[2-8]\d{3})[-\s]?\d{4}", "[PHONE]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3,4}\d{1,4}\b", "[CREDIT_CARD]"),
}

#: Noise in documentation files: flag, pattern.
NOISE: dict[str, str] = {
    "import_lines": r"(?m)^import\s+",
    "export_meta": r"(?m)^export const (title|description|metadata)\b",
    "jsx_tags": r"<[A-Z][A-Za-z0-9]*",
    "site_markers": r"@site/src/components|ComponentCardList|Figure|Admonition|TabItem",
    "frontmatter": r"^---\s*\n[\s\S]*?\n---(\s*\n|$)",
}

#: Lines that are dropped outside code fences.
NOISE_LINES: list[str] = [r"^\s*import\s+.*$", r"^\s*export const (title|description|metadata)\s*=.*$", r"@site/src/components", r"^\s*</?[A-Z][A-Za-z0-9]*(\s+[^>]*)?/?>\s*$"]
NARRATION: list[str] = [r"(?i)^This (section|document|page|guide)\s+(explains|describes|details|covers|focuses on|provides|outlines)\b", r"(?i)^This (section|document|page|guide)\s+is about\b"]

#: What is removed before letters and digits are counted.
PRESENTATION: list[tuple[str, str]] = [
    (r"^\s*---\s*\n[\s\S]*?\n---(?:\s*\n|$)", ""),
    (r"(?i)<(?:script|style|iframe)\b[^>]*>[\s\S]*?</(?:script|style|iframe)>", " "),
    (r"(?i)<(?:script|style|iframe)\b[^>]*/?>", " "),
    (r"<!--[\s\S]*?-->", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"</?[A-Za-z][^>]*>", " "),
    (r"\bhttps?://\S+", " "),
]
REDIRECT_ONLY = r"""(?i)^\s*(?:<!--[\s\S]*?"Redirect"\s*:\s*"[^"]+"[\s\S]*?-->|\{\s*"Redirect"\s*:\s*"[^"]+"\s*\}|\[\s*"Redirect"\s*:\s*"[^"]+"\s*\])\s*$"""
INCLUDE_ONLY = r"""(?i)^\s*--8<--\s*["'][^"']+["']\s*$"""

#: Decision points for cyclomatic complexity.
DECISIONS: list[str] = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bswitch\s*\(", r"\bcase\s+[^:]+:", r"\bdefault\s*:", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bforEach\s*\(", r"&&|\|\|", r"\bcatch\b"]

#: Markers of technical debt: type, weight, pattern.
DEBT: list[tuple[str, int, str]] = [
    ("TODO", 1, r"(?i)//.*\bTODO\b"),
    ("FIXME", 5, r"(?i)//.*\bFIXME\b"),
    ("HACK", 3, r"(?i)//.*\bHACK\b"),
    ("XXX", 3, r"(?i)//.*\bXXX\b"),
    ("BUG", 4, r"(?i)//.*\bBUG\b"),
    ("NOTE", 0, r"(?i)//.*\bNOTE\b"),
    ("DEPRECATED", 2, r"(?i)\b@deprecated\b"),
]
