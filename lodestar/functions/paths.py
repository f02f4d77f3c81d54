"""Predicates and projections of file paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path components, names and suffixes that decide what is scanned.
IGNORED_COMPONENTS = [
    ".git", ".hg", ".svn", ".idea", ".vscode", ".venv", "venv", "env", "node_modules", "dist", "build", "target", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "coverage", ".coverage", "vendor", ".next", "out", "bin", "obj",
]
KEEP_NAMES = [
    "readme", "readme.md", "readme.rst", "license", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "package.json", "package-lock.json",
    "pnpm-lock.yaml", "yarn.lock", "pyproject.toml", "requirements.txt", "pipfile", "poetry.lock", "pom.xml", "build.gradle", "build.gradle.kts",
    "go.mod", "go.sum", "cargo.toml", "cargo.lock", "makefile", "cmakelists.txt",
]
KEEP_SUFFIXES = [".md", ".rst", ".toml", ".yml", ".yaml", ".ini", ".cfg", ".conf", ".json", ".sql", ".graphql", ".proto"]
IGNORED_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".mp4", ".mov", ".avi", ".mp3", ".wav", ".pdf", ".zip", ".tar", ".gz", ".7z", ".exe", ".dll",
    ".so", ".dylib", ".class", ".o", ".obj", ".bin", ".woff", ".woff2", ".ttf", ".eot", ".lock",
]
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".cs": "csharp", ".rs": "rust", ".rb": "ruby", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala",
}
DOT_KEPT = [".env.example", ".gitignore", ".dockerignore"]
SECRET_NAMES = [".env", ".env.local"]
SECRET_SUFFIXES = [".pem", ".key"]
CONFIG_NAMES = [
    ".env.example", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "package.json", "pyproject.toml", "requirements.txt", "pom.xml",
    "build.gradle", "go.mod",
]
CONFIG_SUFFIXES = [".yml", ".yaml", ".toml", ".json", ".ini"]
URL_HOSTS = ["github.com", "www.github.com", "gitlab.com", "www.gitlab.com", "bitbucket.org", "www.bitbucket.org"]


def normalized(path: Column) -> Column:
    """Slashes forward, one at a time and none at the ends; parts that stay in place (.) go. A path of nothing else is a dot."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    whole = F.array_join(parts, "/")
    return F.when((whole == "") & ~path.startswith("/"), ".").otherwise(whole)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """One of fourteen languages, or null."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(known, suffix(path))


def is_ignored(path: Column, extra: list[str] | None = None) -> Column:
    """Whether a scan leaves a relative path out. Components are matched by case, names and suffixes without."""
    components = F.array(*map(F.lit, IGNORED_COMPONENTS + (extra or [])))
    name, end = F.lower(file_name(path)), suffix(path)
    source = end.isin(list(LANGUAGES)) | end.isin(KEEP_SUFFIXES)
    return (
        F.when(F.coalesce(F.length(path), F.lit(0)) == 0, True)
        .when(F.arrays_overlap(F.split(path, "/"), components), True)
        .when(name.isin(KEEP_NAMES), False)
        .when(end.isin(KEEP_SUFFIXES), False)
        .when(end.isin(IGNORED_SUFFIXES), True)
        .when(name.startswith(".") & ~name.isin(DOT_KEPT), ~(source | name.isin(".env", ".env.local")))
        .otherwise(False)
    )


def classification(path: Column) -> Column:
    """secret, test, source, config, documentation, sql or other; the first that holds."""
    name, end, low = F.lower(file_name(path)), suffix(path), F.lower(normalized(path))
    secret = name.isin(SECRET_NAMES) | name.endswith(".pem") | name.endswith(".key")
    known, source = name.isin(KEEP_NAMES) | end.isin(KEEP_SUFFIXES), end.isin(list(LANGUAGES))
    config = name.isin(CONFIG_NAMES) | end.isin(CONFIG_SUFFIXES)
    return (
        F.when(secret, "secret")
        .when(low.contains("test"), "test")
        .when(source, "source")
        .when(known & config, "config")
        .when(known, "documentation")
        .when(end == ".sql", "sql")
        .otherwise("other")
    )


def looks_secret(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.isin(SECRET_NAMES) | name.endswith(".pem") | name.endswith(".key") | (name.startswith(".env.") & (name != ".env.example"))


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.contains(F.substring(content, 1, 8192), F.lit(bytearray(b"\0")))


def safe_member(path: Column) -> Column:
    """An archive member or joined path that stays inside: relative, without parent components."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(p, "/"), "..")


def valid_url(url: Column) -> Column:
    """The trimmed URL without closing slashes if a repository may be fetched from it, else null."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    known = place.isin(URL_HOSTS) | place.endswith(".github.com")
    ok = scheme.isin("https", "http", "git") & (place != "") & (path != "") & ~place.contains("@") & (known | (scheme == "https"))
    return F.when(ok, F.regexp_replace(u, "/+$", ""))


def repository_name(url: Column) -> Column:
    """The last segment without .git."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def github_archive(url: Column, branch: Column) -> Column:
    """Where a GitHub repository's archive is; null for other hosts."""
    owner = F.regexp_extract(url, r"^https?://(?:www\.)?github\.com/([^/]+)/([^/?#]+)", 1)
    name = F.regexp_replace(F.regexp_extract(url, r"^https?://(?:www\.)?github\.com/([^/]+)/([^/?#]+)", 2), r"\.git$", "")
    return F.when(owner != "", F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/archive/refs/heads/"), branch, F.lit(".zip")))
