"""Weakness knowledge: names, advice and defaults. Fixed values."""

NAMES = {
    "CWE-89": "SQL Injection",
    "CWE-798": "Use of Hard-coded Credentials",
    "CWE-79": "Cross-Site Scripting (XSS)",
    "CWE-94": "Code Injection",
    "CWE-78": "OS Command Injection",
}
EXPLANATIONS = {
    "CWE-89": "SQL Injection occurs when untrusted user input is concatenated directly into a SQL query string. An attacker can manipulate the input to modify the intended SQL command, potentially reading, modifying, or deleting data from the database.",
    "CWE-798": "Hardcoded secrets (API keys, passwords, tokens) embedded in source code are accessible to anyone with access to the code repository. This includes developers, CI/CD systems, and potentially attackers if the repository is public or compromised.",
    "CWE-79": "Cross-Site Scripting (XSS) occurs when untrusted data is included in a web page without proper validation or escaping. The attacker can inject malicious scripts that execute in the victim's browser, potentially stealing session tokens or redirecting users to malicious sites.",
    "CWE-94": "Code Injection occurs when an application uses user-supplied input in a code evaluation context (eval, exec, etc.). An attacker can execute arbitrary code within the context of the application.",
    "CWE-78": "OS Command Injection occurs when an application passes user-supplied data to a system shell command. An attacker can execute arbitrary commands on the host operating system.",
}
IMPACTS = {
    "CWE-89": "An attacker can: read sensitive data from the database, modify or delete records, bypass authentication, and in some cases execute operating system commands on the database server.",
    "CWE-798": "An attacker who discovers hardcoded secrets can impersonate the application, access restricted resources, and bypass authentication mechanisms. Secrets in version control history remain even after removal.",
    "CWE-79": "An attacker can: steal session cookies and hijack user accounts, redirect users to phishing pages, deface the application, and spread worms across user accounts.",
    "CWE-94": "An attacker can execute arbitrary code on the server, potentially gaining full control over the application and its hosting environment.",
    "CWE-78": "An attacker can execute arbitrary commands on the server, potentially gaining full control over the system, accessing sensitive files, or pivoting to other systems.",
}
FIXES = {
    "CWE-89": "Use parameterized queries (prepared statements) instead of string concatenation. For Python with SQLAlchemy, use the ORM or text() with bound parameters. For raw SQL, always pass parameters separately from the query string.",
    "CWE-798": "Store secrets in environment variables or a secrets manager (e.g., AWS Secrets Manager, HashiCorp Vault). Use .env files for local development (never committed to version control). Always use os.environ.get() with sensible defaults only for non-sensitive configuration.",
    "CWE-79": "Always escape user-supplied data before rendering in HTML. Use template engines that auto-escape by default (Jinja2, React JSX). Apply Content Security Policy (CSP) headers as a defense-in-depth measure.",
    "CWE-94": "Never use eval() or exec() with user-controlled input. Use JSON.parse() for data parsing, and use allowlisted function dispatch instead of dynamic evaluation.",
    "CWE-78": "Never pass user input directly to shell commands. Use parameterized APIs or allowlisted inputs. If shell execution is necessary, use subprocess with shell=False and pass arguments as a list.",
}
REFERENCES = {
    "CWE-89": ["https://owasp.org/www-community/attacks/SQL_Injection", "https://cwe.mitre.org/data/definitions/89.html"],
    "CWE-798": ["https://owasp.org/www-community/vulnerabilities/Use_of_hard-coded_cryptographic_key", "https://cwe.mitre.org/data/definitions/798.html"],
    "CWE-79": ["https://owasp.org/www-community/attacks/xss/", "https://cwe.mitre.org/data/definitions/79.html"],
    "CWE-94": ["https://owasp.org/www-community/attacks/Code_Injection", "https://cwe.mitre.org/data/definitions/94.html"],
    "CWE-78": ["https://owasp.org/www-community/attacks/Command_Injection", "https://cwe.mitre.org/data/definitions/78.html"],
}
DEFAULT_IMPACT = "Impact analysis not available for this vulnerability type."
DEFAULT_FIX = "Review the identified code and apply security best practices."

# Advice attached to data-flow findings.
FLOW_REMEDIATIONS = {
    "CWE-89": "Use parameterized queries (prepared statements) instead of string concatenation. For Node.js with sqlite3: db.get('SELECT * FROM users WHERE id = ?', [id]). For mysql2: connection.query('SELECT * FROM users WHERE id = ?', [id]).",
    "CWE-78": "Never pass user input directly to shell commands. Use execFile() with argument arrays instead of exec() with string concatenation. Validate and allowlist all inputs.",
    "CWE-94": "Never use eval() with user-controlled input. Use JSON.parse() for data parsing. For dynamic code, use Function constructors with strict allowlisting.",
    "CWE-79": "Escape all user-supplied data before rendering in HTML. Use textContent instead of innerHTML. Apply Content Security Policy headers. Use DOMPurify for HTML sanitization.",
    "CWE-22": "Validate and normalize file paths using path.resolve() and path.normalize(). Restrict file access to a known-safe base directory using startsWith() checks. Never pass user input directly to filesystem APIs.",
    "CWE-918": "Validate URLs against an allowlist of permitted domains/schemes. Block requests to internal/private IP ranges. Use a dedicated HTTP client with URL validation.",
    "CWE-601": "Validate redirect targets against an allowlist of permitted paths. Only allow relative URLs starting with '/'. Never redirect to user-supplied absolute URLs.",
    "CWE-113": "Validate all header values for CRLF sequences (\\r\\n). Use framework-provided header setting methods. Never pass user input directly to setHeader().",
    "CWE-1321": "Use Object.freeze(Object.prototype) or __proto__-safe merge implementations. Validate object keys before merging. Avoid deep merge of user-controlled objects.",
}
