"""Fixed values that decide what is scanned and how a file is labelled."""

# Folder names that are never entered (besides every name starting with a dot).
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", ".bzr",
    "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache",
    "venv", "env", ".venv", ".env", "virtualenv",
    "dist", "build", "out", "target", "bin", "obj",
    ".idea", ".vscode", ".vs", ".sublime",
    "coverage", ".coverage", "htmlcov",
    ".next", ".nuxt", ".cache", ".parcel-cache",
    "vendor", "packages", "bower_components",
)

# Suffixes that make a file with "lock" in its name a lock file.
LOCK_SUFFIXES = (".yaml", ".yml", ".json")

# Extension to fence language; anything else is "text".
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx",
    ".ts": "typescript", ".tsx": "tsx", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".php": "php", ".rb": "ruby",
    ".go": "go", ".rs": "rust", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".r": "r",
    ".html": "html", ".css": "css", ".scss": "scss",
    ".json": "json", ".xml": "xml", ".yaml": "yaml",
    ".yml": "yaml", ".sql": "sql", ".sh": "bash",
    ".md": "markdown", ".txt": "text",
}

# Whole file names that override the extension.
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile"}

# Size limits.
MAX_FILE_MB = 10
PREVIEW_MAX_BYTES = 1024 * 1024
PREVIEW_CHARS = 5000
SEARCH_LIMIT = 50
RETENTION_HOURS = 2

# Import suffixes in the order they are tried.
PYTHON_SUFFIXES = (".py",)
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")
