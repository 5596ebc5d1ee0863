"""Which files are indexed: fixed lists of names, and predicates on path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists below decide which files are indexed, so they must be these.
IGNORED_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "web_modules", ".git", ".svn", ".hg", ".bzr", ".claude",
    ".cursor", ".aider", ".vscode", ".idea", ".vs", ".atom", "dist", "dist-server", "dist-ssr", "dist-client",
    "build", "built", "out", "out-tsc", "target", "storybook-static", ".docusaurus", ".gatsby", ".vuepress", ".nuxt",
    ".next", ".tsc", ".cache", ".parcel-cache", ".vite", ".turbo", ".npm", ".yarn", ".pnp", ".pnpm-store", ".rush",
    ".lerna", ".nx", "coverage", ".nyc_output", ".coverage", "htmlcov", "test-results", "__tests__", "__mocks__",
    "__snapshots__", "__fixtures__", "cypress", "playwright", ".tox", ".eggs", ".hypothesis", ".pyre", ".pytype",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", ".gradle", ".mvn", "Pods", "DerivedData",
    ".bundle", "xcuserdata", "pkg", ".terraform", ".terragrunt-cache", ".pulumi", ".serverless", ".firebase", ".aws",
    ".azure", ".gcloud", ".vercel", ".netlify", "temp", "tmp", ".tmp", ".temp", ".llamaindex", ".chroma",
    ".vectorstore", ".embeddings", ".langchain", ".autogen", ".semantic-kernel", ".openai-cache", ".anthropic-cache",
    "embeddings", "vector-db", "faiss-index", "chromadb", "pinecone-cache", "weaviate-data", ".pnpm", ".bun",
    "assets", "static", "public", "wwwroot", "www", ".plugkit-browser-profile", "cmake_build_debug",
    "cmake_build_release", "CMakeFiles", ".code-search", ".gm",
)
IGNORED_DIR_SUFFIXES = (
    "-browser-profile", "-chrome-profile", "-firefox-profile", "-edge-profile", ".egg-info", ".dist-info",
)
IGNORED_DIR_PREFIXES = (
    "chromium-", "chrome-user-data-", "puppeteer-", "playwright-",
)
CODE_EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".pyw", ".pyi", ".java", ".c", ".cpp",
    ".cc", ".cxx", ".h", ".hpp", ".hh", ".hxx", ".cs", ".csx", ".go", ".rs", ".rb", ".erb", ".php", ".phtml",
    ".swift", ".kt", ".kts", ".scala", ".sc", ".pl", ".pm", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".psm1",
    ".psd1", ".lua", ".r", ".jl", ".dart", ".ex", ".exs", ".erl", ".hrl", ".hs", ".lhs", ".clj", ".cljs", ".cljc",
    ".lisp", ".lsp", ".scm", ".ss", ".rkt", ".f", ".for", ".f90", ".f95", ".f03", ".asm", ".s", ".groovy", ".gvy",
    ".vb", ".vbs", ".fs", ".fsx", ".ml", ".mli", ".mm", ".ino", ".vue", ".svelte", ".coffee", ".re", ".rei", ".xml",
    ".xsd", ".html", ".htm", ".yml", ".yaml", ".toml", ".json", ".css", ".scss", ".sass", ".less", ".sql", ".md",
    ".markdown", ".txt", ".prd", ".pdf",
)
BINARY_EXTENSIONS = (
    ".zip", ".tar", ".gz", ".rar", ".7z", ".iso", ".exe", ".dll", ".so", ".dylib", ".bin", ".jpg", ".jpeg", ".png",
    ".gif", ".bmp", ".svg", ".ico", ".mp3", ".mp4", ".mov", ".avi", ".flv", ".m4a", ".doc", ".docx", ".xls", ".xlsx",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
)
BUILT_IN_PATTERNS = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock", "Pipfile.lock", "Cargo.lock",
    "composer.lock", "go.sum", ".DS_Store", "Thumbs.db", "desktop.ini", ".tern-port",
)


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_ignored_dir(name: Column) -> Column:
    """Whether a directory of this name is left out."""
    found = name.isin(*IGNORED_DIRS)
    for suffix in IGNORED_DIR_SUFFIXES:
        found = found | name.endswith(suffix)
    for prefix in IGNORED_DIR_PREFIXES:
        found = found | name.startswith(prefix)
    return found


def in_ignored_dir(path: Column, with_name: bool = True) -> Column:
    """Whether a component is an ignored directory; ``with_name`` tests the file name too."""
    parts = F.split(normal_path(path), "/")
    if not with_name:
        parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.lit(1), F.lit(0)))
    return F.exists(parts, is_ignored_dir)


def extension(path: Column) -> Column:
    """From the last dot on, in lower case; '' without a dot."""
    return F.regexp_extract(F.lower(path), r"(?s)(\.[^.]*)$", 1)


def is_code_file(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS)


def is_binary_file(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def ignored_dir_name(name: str) -> bool:
    """``is_ignored_dir`` for a source that walks folders."""
    return name in _IGNORED or name.endswith(IGNORED_DIR_SUFFIXES) or name.startswith(IGNORED_DIR_PREFIXES)


def indexed_ending(path: str) -> bool:
    """``is_code_file`` and not ``is_binary_file``, likewise."""
    _, dot, ending = path.lower().rpartition(".")
    return dot + ending in _INDEXED


_IGNORED = frozenset(IGNORED_DIRS)
_INDEXED = frozenset(CODE_EXTENSIONS) - frozenset(BINARY_EXTENSIONS)
