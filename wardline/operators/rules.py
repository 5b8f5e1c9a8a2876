"""Detection rules. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule: str
    pattern: str
    vulnerability_type: str
    cwe_id: str
    severity: str
    title: str = ""
    description: str = ""
    remediation: str = ""
    confidence: float = 0.85
    credential: bool = False
    # Literals a match cannot do without, lower case: one of every group must occur.
    needs: tuple[tuple[str, ...], ...] = ()
    # The first group of the pattern is the name that title and description speak of.
    names: bool = False

    @property
    def ignores_case(self) -> bool:
        return "i" in self.pattern[: self.pattern.find(")")] if self.pattern.startswith("(?") else False


SQL_PARTS = (("select", "insert", "update", "delete"), ("${", "+", ".format", "%("))
CREDENTIAL_WORDS = ("password", "passwd", "secret", "api_key", "apikey", "token", "auth_key")
QUOTES = ("\"", "'")
PAGE_WRITES = ("innerhtml", "document.write")
COMMANDS = ("exec", "spawn")

# Flags: (?i) ignore case, (?U) Unicode classes and case, (?s) dot matches newline.
REGEX_RULES = [
    Rule(
        "sql",
        r"(?iUs)SELECT\s+.*?\$\{[^}]+\}"
        r"|INSERT\s+.*?\$\{[^}]+\}"
        r"|UPDATE\s+.*?\$\{[^}]+\}"
        r"|DELETE\s+.*?\$\{[^}]+\}"
        r"|SELECT\s+.*?'\s*\+\s*\w+\s*\+\s*'"
        r"|SELECT\s+.*?\.format\s*\("
        r"|SELECT\s+.*?%\([^)]+\)[sd]",
        "SQL Injection",
        "CWE-89",
        "critical",
        description="User input is concatenated directly into a SQL query string, allowing an attacker to modify the intended SQL command.",
        remediation="Use parameterized queries (prepared statements) instead of string concatenation or template literals.",
        needs=SQL_PARTS,
    ),
    Rule(
        "credentials",
        r"(?iU)(?:password|passwd|secret|api_key|apikey|token|auth_key)\s*[:=]\s*[\"'][^\"']{4,}[\"']",
        "Hardcoded Credentials",
        "CWE-798",
        "high",
        description="Hardcoded secrets embedded in source code are accessible to anyone with access to the code repository.",
        remediation="Store secrets in environment variables or a secrets manager. Never commit credentials to source control.",
        credential=True,
        needs=(CREDENTIAL_WORDS, QUOTES),
    ),
    Rule(
        "xss",
        r"(?iU)\.innerHTML\s*=\s*.*?(?:req|request|query|params|input|user)"
        r"|document\.write\s*\(.*?(?:req|request|query|params|input|user)",
        "Cross-Site Scripting (XSS)",
        "CWE-79",
        "high",
        description="User-controlled data is inserted into HTML without proper escaping, allowing script injection.",
        remediation="Escape all user-supplied data before rendering in HTML. Use textContent instead of innerHTML.",
        needs=(PAGE_WRITES,),
    ),
    Rule(
        "eval",
        r"(?iU)\beval\s*\(\s*.*?(?:req|request|query|params|input|user|body)",
        "Code Injection",
        "CWE-94",
        "critical",
        description="User input is passed to eval(), allowing arbitrary code execution.",
        remediation="Never use eval() with user-controlled input. Use JSON.parse() for data or Function() with strict allowlisting.",
        needs=(("eval",),),
    ),
    Rule(
        "command",
        r"(?iU)(?:exec|execSync|spawn|execFile)\s*\(\s*.*?(?:req|request|query|params|input|user|body)",
        "Command Injection",
        "CWE-78",
        "critical",
        description="User input is passed to a system command execution function, allowing arbitrary command injection.",
        remediation="Never pass user input directly to shell commands. Use allowlisted inputs or parameterized APIs.",
        needs=(COMMANDS,),
    ),
]

# The knowledge-base detector: wider variants, names and advice from the knowledge base.
KNOWLEDGE_RULES = [
    Rule(
        "sql",
        r"(?iUs)(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+.*?"
        r"(?:"
        r"[\"']\s*\+\s*[\w.]+\s*\+\s*[\"']"
        r"|`[^`]*\$\{[^}]+\}[^`]*`"
        r"|f[\"'][^\"']*\{[^}]+\}[^\"']*[\"']"
        r"|\.format\s*\([^)]*\)"
        r"|%\([^)]+\)[sd]"
        r")",
        "SQL Injection",
        "CWE-89",
        "critical",
        needs=(("select", "insert", "update", "delete", "drop"), ("${", "+", "f\"", "f'", ".format", "%(")),
    ),
    Rule(
        "credentials",
        r"(?iU)(?:password|passwd|secret|api_key|apikey|token|auth_key|db_pass)\s*[:=]\s*[\"'][^\"']{4,}[\"']",
        "Use of Hard-coded Credentials",
        "CWE-798",
        "high",
        credential=True,
        needs=((*CREDENTIAL_WORDS, "db_pass"), QUOTES),
    ),
    Rule(
        "xss",
        r"(?iU)\.innerHTML\s*=\s*.*?(?:req|request|query|params|input|user|body)"
        r"|document\.write\s*\(.*?(?:req|request|query|params|input|user|body)",
        "Cross-Site Scripting (XSS)",
        "CWE-79",
        "high",
        needs=(PAGE_WRITES,),
    ),
    Rule(
        "eval",
        r"(?iU)\b(?:eval|exec)\s*\(\s*.*?(?:req|request|query|params|input|user|body)",
        "Code Injection",
        "CWE-94",
        "critical",
        needs=(("eval", "exec"),),
    ),
    Rule(
        "command",
        r"(?iU)(?:exec|execSync|spawn|execFile)\s*\(\s*.*?(?:req|request|query|params|input|user|body)",
        "OS Command Injection",
        "CWE-78",
        "critical",
        needs=(COMMANDS,),
    ),
]

# The measuring detector: first match outside comment lines, per pattern.
BENCHMARK_RULES = [
    Rule("sql_concat", r"(?U)execute\s*\(\s*[\"']SELECT.*\+\s*\w", "SQL Injection", "CWE-89", "high", needs=(("execute",), ("SELECT",))),
    Rule("sql_fstring", r"(?U)execute\s*\(\s*f[\"']SELECT", "SQL Injection", "CWE-89", "high", needs=(("execute",), ("SELECT",))),
    Rule("password", r"(?U)password\s*=\s*[\"'][^\"']+[\"']", "Hardcoded Credentials", "CWE-798", "high", needs=(("password",),)),
    Rule("api_key", r"(?U)api_key\s*=\s*[\"'][^\"']+[\"']", "Hardcoded Credentials", "CWE-798", "high", needs=(("api_key",),)),
    Rule("secret", r"(?U)secret\s*=\s*[\"'][^\"']+[\"']", "Hardcoded Credentials", "CWE-798", "high", needs=(("secret",),)),
    Rule("eval", r"(?U)\beval\s*\(", "Eval Injection", "CWE-95", "high", needs=(("eval",),)),
    Rule("exec", r"(?U)\bexec\s*\(", "Eval Injection", "CWE-95", "high", needs=(("exec",),)),
    Rule("path_join", r"(?U)os\.path\.join\s*\([^)]*\+\s*\w", "Path Traversal", "CWE-22", "high", needs=(("os.path.join",),)),
    Rule("pickle", r"(?U)pickle\.loads?\s*\(", "Insecure Deserialization", "CWE-502", "high", needs=(("pickle.load",),)),
    Rule(
        "yaml",
        r"(?U)yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.Loader",
        "Insecure Deserialization",
        "CWE-502",
        "high",
        needs=(("yaml.load",), ("yaml.Loader",)),
    ),
    Rule("xss", r"(?U)return\s*f[\"'].*\{.*request\.", "Cross-Site Scripting", "CWE-79", "high", needs=(("request.",),)),
]

SECRET_NAMES = (
    "password", "passwd", "secret", "api_key", "apikey", "token", "auth_key", "db_pass", "private_key", "access_key", "secret_key",
)
SECRET_NAME = r"([\w$]*(?:" + "|".join(SECRET_NAMES) + r")[\w$]*)"
SECRET_VALUE = r"\s*=\s*(?:\"[^\"]{6,}\"|'[^']{6,}')"

# Line rules for scripts. Without a parser, multi-line and nested cases are missed.
SCRIPT_RULES = [
    Rule(
        "eval",
        r"(?<![\w$.])eval\s*\(",
        "Code Injection",
        "CWE-94",
        "critical",
        "Use of eval()",
        "eval() executes arbitrary JavaScript code and is a security risk even without direct user input.",
        "Never use eval() with user-controlled input. Use JSON.parse() for data parsing or a safe expression evaluator.",
        0.95,
        needs=(("eval",),),
    ),
    Rule(
        "docwrite",
        r"(?<![\w$.])document\.write\s*\(",
        "Cross-Site Scripting (XSS)",
        "CWE-79",
        "medium",
        "Use of document.write()",
        "document.write() can lead to XSS if used with untrusted input.",
        "Use DOM manipulation methods (createElement, textContent) instead of document.write().",
        0.80,
        needs=(("document.write",),),
    ),
    Rule(
        "innerHTML",
        r"\.innerHTML\s*\+?=(?!=)",
        "Cross-Site Scripting (XSS)",
        "CWE-79",
        "high",
        "innerHTML assignment",
        "Direct innerHTML assignment is vulnerable to XSS if the value contains user input.",
        "Use textContent or innerText instead of innerHTML. If HTML is required, sanitize with DOMPurify.",
        0.70,
        needs=((".innerHTML",),),
    ),
    Rule(
        "timer",
        r"(?<![\w$.])(?:setTimeout|setInterval)\s*\(\s*[\"']",
        "Code Injection via setTimeout/setInterval",
        "CWE-94",
        "high",
        "setTimeout/setInterval with string argument",
        "setTimeout/setInterval with string argument acts like eval() and can lead to code injection.",
        "Pass a function reference instead of a string to setTimeout/setInterval.",
        0.85,
        needs=(("setTimeout", "setInterval"),),
    ),
    Rule(
        "secret",
        # any declarator of the statement, with or without a type
        r"(?i)\b(?:const|let|var)\s+(?:[^;]*?,\s*)?" + SECRET_NAME + r"(?:\s*:\s*[^=;,]+?)?" + SECRET_VALUE,
        "Hardcoded Credentials",
        "CWE-798",
        "high",
        "Hardcoded secret: {}",
        "Hardcoded secret '{}' embedded in source code. Secrets should be stored in environment variables or a secrets manager.",
        "Store secrets in environment variables (process.env) or a secrets manager. Never commit credentials to source control.",
        0.90,
        needs=(SECRET_NAMES, QUOTES),
        names=True,
    ),
    Rule(
        "secret_member",
        r"(?i)\." + SECRET_NAME + SECRET_VALUE,
        "Hardcoded Credentials",
        "CWE-798",
        "high",
        "Hardcoded secret: {}",
        "Hardcoded secret '{}' embedded in source code.",
        "Store secrets in environment variables or a secrets manager.",
        0.90,
        needs=(SECRET_NAMES, QUOTES),
        names=True,
    ),
]
