"""Rule catalogs.

FIXED VALUES: every list and map in this module must equal the source tool's
values for results to match (patterns, keywords, extensions, thresholds). They
are kept here plainly, in their natural order.
"""

from __future__ import annotations

# ---- FIXED VALUES: process output error patterns (checked in this order) ----
PROCESS_ERROR_PATTERNS = [
    r"Error: .+",
    r"TypeError: .+",
    r"SyntaxError: .+",
    r"Module not found: .+",
    r"Failed to compile",
    r"Compilation error",
    r"panic: .+",
    r"fatal error: .+",
    r'cannot find package ".+"',
    r"undefined: .+",
    r"Traceback \(most recent call last\)",
    r"ImportError: .+",
    r"SyntaxError: .+",
    r"NameError: .+",
    r"FAIL .+",
    r"Error: expect\(.+\)",
    r"AssertionError",
    r"EADDRINUSE .+",
    r"listen EADDRINUSE .+",
    r"Connection refused",
    r"ECONNREFUSED",
    r"(?i)error.*",
    r"(?i)exception.*",
    r"(?i)failed.*",
    r"(?i)fatal.*",
]

# ---- FIXED VALUES: error patterns that a dev server is started with, by its type ----
DEV_SERVER_PATTERNS = {
    "npm": ["Error:", "Failed to compile", "Module not found"],
    "go": ["panic:", "fatal error:", "cannot find package"],
    "python": ["Traceback", "ImportError:", "SyntaxError:"],
    "next": ["Error:", "Failed to compile", "Module not found"],
    "vite": ["Error:", "Failed to compile", "Module not found"],
}

# ---- FIXED VALUES: severity and error type of a process error line ----
WARNING_PATTERN = r"(?i)(warn|warning)"
ERROR_TYPE_PATTERNS = [
    ("compilation", r"(?i)(syntax|parse|compile)"),
    ("test", r"(?i)(test|spec|assertion)"),
    ("server", r"(?i)(server|port|listen|connect)"),
]
DEFAULT_ERROR_TYPE = "runtime"

# ---- FIXED VALUES: security regexes of the code analyzer (pattern, description) ----
SECURITY_PATTERNS = [
    (r"""(?i)(password|secret|key|token)\s*[:=]\s*["'][^"']*["']""", "Hardcoded credentials"),
    (r"(?i)eval\s*\(", "Code injection risk"),
    (r"(?i)exec\s*\(", "Command injection risk"),
    (r"(?i)sql\s*\+", "SQL injection risk"),
    (r"(?i)innerHTML\s*=", "XSS vulnerability"),
]

# ---- FIXED VALUES: comment-smell regex and todo markers (priority order) ----
TODO_SMELL_PATTERN = r"(?i)(TODO|FIXME|HACK|XXX)"
TODO_MARKERS = ["TODO", "FIXME", "HACK", "NOTE", "XXX"]

# ---- FIXED VALUES: analyzer file types and languages ----
ANALYZABLE_EXTS = [".go", ".py", ".js", ".ts", ".java", ".cpp", ".c", ".cs", ".php", ".rb"]
ANALYZER_LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".php": "php", ".rb": "ruby",
}

# ---- FIXED VALUES: core extension map (default "text") and code files ----
CORE_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".py": "python", ".java": "java", ".cpp": "cpp", ".c": "c", ".cs": "csharp",
    ".rb": "ruby", ".php": "php", ".rs": "rust", ".kt": "kotlin", ".swift": "swift",
}
CODE_EXTS = [".js", ".jsx", ".ts", ".tsx", ".go", ".py", ".java", ".cpp", ".c", ".cs", ".rb", ".php", ".rs"]
MAIN_FILES = ["main.go", "main.py", "index.js", "index.ts", "app.js", "app.py", "server.js"]
CONFIG_FILES = [
    "package.json", "go.mod", "requirements.txt", "cargo.toml", "pom.xml",
    "composer.json", "gemfile", "dockerfile", ".gitignore", ".env",
    "tsconfig.json", "webpack.config.js", "babel.config.js",
]
PROJECT_TYPES = [
    ("package.json", "nodejs"), ("go.mod", "go"), ("requirements.txt", "python"),
    ("cargo.toml", "rust"), ("pom.xml", "java"), ("composer.json", "php"),
]
DIR_PURPOSES = {
    "src": "source", "lib": "library", "test": "test", "tests": "test", "spec": "test",
    "docs": "documentation", "config": "configuration", "scripts": "scripts", "assets": "assets",
    "static": "static", "public": "public", "components": "components", "pages": "pages",
    "api": "api", "utils": "utilities", ".gitignore": "configuration", ".env": "configuration",
    "tsconfig.json": "configuration", "webpack.config.js": "configuration",
    "babel.config.js": "configuration",
}
STRUCTURE_SKIP_DIRS = ["node_modules", "vendor", "target", ".git", "dist", "build"]
STRUCTURE_KEEP_DOTNAMES = [".env", ".gitignore"]

# ---- FIXED VALUES: performance optimisation priorities (default medium) ----
OPTIMIZATION_PRIORITY = {
    "nested_loops": "high", "string_concatenation": "medium",
    "inefficient_query": "high", "memory_leak": "critical",
}

# ---- FIXED VALUES: process request allow-list ----
ALLOWED_COMMANDS = ["npm", "node", "go", "python", "yarn", "cargo", "next", "vite", "jest", "make", "mvn", "gradle"]
MAX_COMMAND_LENGTH = 1000

# ---- FIXED VALUES: suggestion-engine keywords (lower-cased text is searched) ----
SECURITY_KEYWORDS = [
    ("password", "Avoid hardcoded passwords"),
    ("api_key", "Avoid hardcoded API keys"),
    ("secret", "Avoid hardcoded secrets"),
    ("token", "Be careful with token handling"),
    ("eval(", "Avoid eval() - security risk"),
    ("exec(", "Avoid exec() - security risk"),
    ("shell=True", "shell=True can be dangerous"),
    ("innerHTML", "innerHTML can lead to XSS"),
    ("document.write", "document.write can lead to XSS"),
]
DEBUG_CALLS = ["console.log", "print(", "println(", "fmt.Print", "System.out.print"]

# ---- FIXED VALUES: thresholds ----
LONG_LINE = 120
NESTED_LOOP_LOOKAHEAD = 9          # analyzer looks at the next 9 lines
COMPLEXITY_LIMIT = 10
MAX_OUTPUT_LINES = 10000
MAX_CHANGES = 100
DEFAULT_TAIL = 50
CONTEXT_LINES = 5

# ---- FIXED VALUES: language plug-in error patterns, first match wins per line ----
# (pattern, type, severity, file_regex, line_regex, column_regex); '' = not extracted
LANGUAGE_PATTERNS = {
    "javascript": [
        (r"SyntaxError: .+", "syntax", "error", r"at (.+):(\d+):(\d+)", r"at .+:(\d+):\d+", r"at .+:\d+:(\d+)"),
        (r"TypeError: .+", "runtime", "error", r"at (.+):(\d+):(\d+)", r"at .+:(\d+):\d+", r"at .+:\d+:(\d+)"),
        (r"ReferenceError: .+", "runtime", "error", r"at (.+):(\d+):(\d+)", r"at .+:(\d+):\d+", r"at .+:\d+:(\d+)"),
        (r"Module not found: .+", "build", "error", r"in (.+)", "", ""),
        (r"Failed to compile", "build", "error", "", "", ""),
        (r"warning .+", "lint", "warning", r"(.+):\d+:\d+", r".+:(\d+):\d+", r".+:\d+:(\d+)"),
    ],
    "typescript": [
        (r"error TS\d+: .+", "syntax", "error", r"(.+)\(\d+,\d+\):", r".+\((\d+),\d+\):", r".+\(\d+,(\d+)\):"),
        (r"\(\d+,\d+\): error TS\d+: .+", "type", "error", r"(.+)\(\d+,\d+\):", r".+\((\d+),\d+\):", r".+\(\d+,(\d+)\):"),
        (r"Cannot find module .+", "import", "error", r"in (.+)", "", ""),
        (r"Property .+ does not exist on type .+", "type", "error", "", "", ""),
        (r"Argument of type .+ is not assignable to parameter of type .+", "type", "error", "", "", ""),
        (r"warning TS\d+: .+", "lint", "warning", r"(.+)\(\d+,\d+\):", r".+\((\d+),\d+\):", r".+\(\d+,(\d+)\):"),
    ],
    "python": [
        (r"SyntaxError: .+", "syntax", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"IndentationError: .+", "syntax", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"NameError: .+", "runtime", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"TypeError: .+", "runtime", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"AttributeError: .+", "runtime", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"ImportError: .+", "import", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"ModuleNotFoundError: .+", "import", "error", r'File "(.+)", line (\d+)', r"line (\d+)", ""),
        (r"FAILED .+ - .+", "test", "error", "", "", ""),
        (r"ERROR .+ - .+", "test", "error", "", "", ""),
    ],
    "go": [
        (r"(.+\.go):(\d+):(\d+): (.+)", "compile", "error", r"(.+\.go):(\d+):(\d+):", r".+\.go:(\d+):\d+:", r".+\.go:\d+:(\d+):"),
        (r"panic: .+", "runtime", "error", "", "", ""),
        (r"cannot find package .+", "import", "error", "", "", ""),
        (r"undefined: .+", "compile", "error", "", "", ""),
    ],
    "java": [
        (r"(.+\.java):(\d+): error: (.+)", "compile", "error", r"(.+\.java):(\d+):", r".+\.java:(\d+):", ""),
    ],
    "csharp": [
        (r"(.+\.cs)\((\d+),(\d+)\): error (.+): (.+)", "compile", "error", r"(.+\.cs)\((\d+),(\d+)\):", r".+\.cs\((\d+),\d+\):", ""),
    ],
    "rust": [
        (r"error\[E\d+\]: (.+)", "compile", "error", "", "", ""),
        (r"warning: (.+)", "lint", "warning", "", "", ""),
    ],
    "php": [
        (r"Parse error: (.+) in (.+) on line (\d+)", "syntax", "error", "", "", ""),
    ],
    "ruby": [
        (r"(.+\.rb):(\d+): (.+)", "syntax", "error", "", "", ""),
    ],
}

# captured tool -> language whose plug-in parses its output
TOOL_LANGUAGE = {
    "tsc": "typescript", "go": "go", "gotest": "go", "flake8": "python", "mypy": "python",
    "pytest": "python", "unittest": "python", "javac": "java", "jest": "javascript",
}
