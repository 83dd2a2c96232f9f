"""Fixed values. Results depend on each of them being exactly this."""

# --- fixed values: names that never resolve by bare name ------------------------------
BUILTINS = (
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set",
    "tuple", "isinstance", "issubclass", "getattr", "setattr", "hasattr", "delattr",
    "super", "type", "repr", "hash", "iter", "next", "enumerate", "zip", "map",
    "filter", "sorted", "reversed", "sum", "min", "max", "abs", "any", "all",
    "open", "format", "vars", "dir", "id", "callable", "property", "staticmethod",
    "classmethod", "object", "Exception", "ValueError", "TypeError", "KeyError",
    "AttributeError", "RuntimeError", "NotImplementedError", "append", "get",
    "add", "update", "join", "split", "strip", "startswith", "endswith", "items",
    "keys", "values", "pop", "copy", "extend", "insert", "remove", "format_map",
    "setdefault", "popitem", "clear", "discard", "sort", "count", "index",
    "find", "replace", "lower", "upper", "title", "encode", "decode",
    "read", "write", "close", "seek", "flush", "splitlines", "rstrip", "lstrip",
)

# --- fixed values: which paths are source, and which are tests ------------------------
SKIP_DIRS = (
    ".git", ".github", ".venv", "venv", "env", "node_modules", "__pycache__",
    "coverage", ".next", ".nuxt", "vendor", "third_party",
    ".pytest_cache", ".mypy_cache", ".tox", "build", "dist", "site-packages",
    ".idea", ".vscode", "docs", "examples",
)
TEST_DIRS = ("test", "tests")
TEST_PREFIXES = ("test_", "conftest")
TEST_INFIXES = (".test.", ".spec.", ".min.", ".d.")
TEST_SUFFIXES = ("_test.py", "setup.py")

# --- fixed values: languages, their extensions, and the leading folders dropped -------
LANGUAGES = {
    "python": ((".py",), ("src", "lib")),
    "javascript": ((".js", ".jsx", ".mjs", ".cjs"), ("src", "lib", "dist")),
    "typescript": ((".ts", ".mts"), ("src", "lib", "dist")),
    "tsx": ((".tsx",), ("src", "lib", "dist")),
}

# --- fixed values: size limits --------------------------------------------------------
CHUNK_CHARS, CHUNK_OVERLAP_LINES = 1000, 8
MAX_EXAMPLE_LINES, MAX_EXAMPLES = 28, 2
MAX_MODULE_EDGES, MAX_DIAGRAM_NODES, MAX_PHASES = 18, 16, 6
MAX_MANIFEST_DEPS, MAX_BLOCK_CHARS, MAX_INSTALL_LINES, MAX_RUNNABLE = 12, 700, 4, 8
MAX_ALTERNATIVE_DEPS, MAX_CANDIDATES = 6, 3
DESCRIBE_SOURCE_CHARS, ANSWER_SOURCE_CHARS = 2200, 1400
MIN_RELEVANCE, LOW_RELEVANCE = 0.33, 0.25
PACKAGE_VERSION = 2

README_NAMES = ("README.md", "README.rst", "README.txt", "README", "readme.md", "Readme.md")

# --- fixed values: words and patterns the text rules look for -------------------------
TRAILING_WORDS = ("into", "to", "for", "with", "by", "of", "a", "an", "the", "and",
                  "or", "in", "on", "from", "as", "that", "which", "it", "its")
KIND_WORDS = ("class", "module", "function", "method", "file",
              "package", "repository", "codebase", "source")
NO_VALUE_WORDS = ("none", "nothing")
IGNORED_MENTION = r"[\s/]|\.py$|^[a-z_]{1,4}$"
LEAKED_FACTS = (r"(?is)\n+(?:calls \(verified\)|called by \(verified\)|purpose|takes|returns|"
                r"confidence)\s*:.*")
ROLE_LABEL = (r"(?i)\s*\((?:orchestrator|entry point|shared helper|supporting|type|method|"
              r"function|class)\)")
DEAD_SUMMARY = (r"(?i)\b(deprecated|no longer maintained|unmaintained|abandoned|"
                r"use the stdlib|do not use|placeholder|reserved name|renamed to)\b")
INSTALL_LINE = r"^(pip|pip3|python -m pip|uv|poetry|pipenv|conda)\s+(install|add|sync)\b"
MAIN_GUARD = r"(?m)^if\s+__name__\s*==\s*[\"']__main__[\"']"
RUN_SCRIPTS = ("start", "dev", "build", "test")
READING_STEPS = 6
#: Characters whose capital is several letters, with the single one that Unicode has for them, or themselves.
SINGLE_CAPITALS = {c: chr(0x1E9E) if c == chr(0xDF) else c.title() if len(c.title()) == 1 else c
                   for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}
