"""Definition and call patterns by language, as data."""

# The first pattern that matches a line gives its symbol's kind.
# \s and \b are spelled out, since the dialects differ on them.
GO = (
    ("function", r"^[\t\n\f\r ]*func[\t\n\f\r ]+(?:\([^)]*\)[\t\n\f\r ]*)?([0-9A-Za-z_]+)"),
    ("type", r"^[\t\n\f\r ]*type[\t\n\f\r ]+([0-9A-Za-z_]+)[\t\n\f\r ]+struct(?:[^0-9A-Za-z_]|$)"),
    ("interface", r"^[\t\n\f\r ]*type[\t\n\f\r ]+([0-9A-Za-z_]+)[\t\n\f\r ]+interface(?:[^0-9A-Za-z_]|$)"),
    ("type", r"^[\t\n\f\r ]*type[\t\n\f\r ]+([0-9A-Za-z_]+)[\t\n\f\r ]+[^(]"),
)
TS = (
    ("function", r"^[\t\n\f\r ]*(?:export[\t\n\f\r ]+)?(?:async[\t\n\f\r ]+)?function[\t\n\f\r ]+([0-9A-Za-z_]+)"),
    ("class", r"^[\t\n\f\r ]*(?:export[\t\n\f\r ]+)?(?:abstract[\t\n\f\r ]+)?class[\t\n\f\r ]+([0-9A-Za-z_]+)"),
    ("interface", r"^[\t\n\f\r ]*(?:export[\t\n\f\r ]+)?interface[\t\n\f\r ]+([0-9A-Za-z_]+)"),
    ("type", r"^[\t\n\f\r ]*(?:export[\t\n\f\r ]+)?type[\t\n\f\r ]+([0-9A-Za-z_]+)"),
    ("const", r"^[\t\n\f\r ]*export[\t\n\f\r ]+const[\t\n\f\r ]+([0-9A-Za-z_]+)"),
)
PY = (
    ("function", r"^[\t\n\f\r ]*(?:async[\t\n\f\r ]+)?def[\t\n\f\r ]+([0-9A-Za-z_]+)"),
    ("class", r"^[\t\n\f\r ]*class[\t\n\f\r ]+([0-9A-Za-z_]+)"),
)
BY_EXTENSION = ((GO, (".go",)), (TS, (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")), (PY, (".py", ".pyw")))
EXTENSIONS = tuple(e for _, some in BY_EXTENSION for e in some)
CALL = r"(?<![0-9A-Za-z_])[A-Za-z_][0-9A-Za-z_]*[\t\n\f\r ]*\("
CALL_NAME = r"^[0-9A-Za-z_]+"

# Directories never entered, extensions read and never read.
SKIPPED_DIRS = (".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".next", "out", "coverage", ".cache")
ALLOWED = (
    ".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyw", ".rs", ".java", ".kt",
    ".kts", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".cs", ".rb", ".php", ".swift", ".scala",
    ".sc", ".vue", ".svelte", ".sh", ".bash", ".zsh", ".sql", ".proto",
)
DENIED = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".pdf", ".zip", ".gz", ".tar", ".bz2",
    ".7z", ".rar", ".bin", ".exe", ".dll", ".so", ".dylib", ".a", ".o", ".obj", ".woff", ".woff2",
    ".ttf", ".eot", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".wasm", ".pyc", ".class", ".jar",
)
