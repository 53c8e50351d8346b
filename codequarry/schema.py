"""Schemas of the stored relations and the fixed vocabulary of the code index."""

from __future__ import annotations

SCHEMA_VERSION = 4

FILES = "file_id long, path string, hash string, lang string, size_bytes long, parse_quality string, indexed_at timestamp, mtime_nanos long"
CHUNKS = (
    "chunk_id long, file_id long, start_line int, end_line int, start_byte int, end_byte int, kind string, ident string, parent string, "
    "signature string, visibility string, ui_ctx string, doc_comment string, attributes string, content string"
)
REFS = "ref_id long, chunk_id long, target_ident string, ref_kind string, line int, col int"
SAVINGS = (
    "command string, output_tokens long, alternative_tokens long, files_touched long, engine_input_tokens long, alt_input_tokens long, "
    "engine_calls long, alt_calls long, created_at timestamp"
)
ISSUES = "ts string, file string, lang string, issue string, line int, context string, known boolean, test string"

# Kinds, reference kinds and the languages by file extension.
CHUNK_KINDS = ["fn", "method", "struct", "enum", "enum_variant", "trait", "impl", "class", "interface", "mod", "const", "section", "page"]
REF_KINDS = ["call", "import", "type_use", "field_access"]
LANGUAGES = {
    "rust": ["rs"], "go": ["go"], "java": ["java"], "csharp": ["cs"], "python": ["py", "pyi"], "php": ["php"],
    "javascript": ["js", "jsx"], "typescript": ["ts"], "tsx": ["tsx"], "html": ["html", "htm"], "css": ["css"],
    "markdown": ["md", "markdown"], "pdf": ["pdf"], "yaml": ["yaml", "yml"], "toml": ["toml"], "json": ["json"], "bash": ["sh", "bash"], "sql": ["sql"],
    "xml": ["xml", "csproj", "fsproj", "vbproj", "props", "targets"], "c": ["c", "h"], "cpp": ["cpp", "hpp", "cc", "cxx"],
    "plaintext": ["txt", "rst", "ini", "cfg", "properties", "proto", "graphql", "gql", "tf", "hcl", "sln", "gradle", "kts"],
}
EXTENSIONS = {ext: lang for lang, exts in LANGUAGES.items() for ext in exts}
SUPPORTED = [ext for ext in EXTENSIONS if ext not in ("htm", "cc", "cxx")]
# Folders that are never walked.
SKIPPED_FOLDERS = ["node_modules", "target", "dist", "build", "vendor", "__pycache__", ".git", ".venv", "venv"]
MAX_FILE_MB = 10
CODE_LANGUAGES = ["rust", "go", "java", "csharp", "python", "php", "javascript", "typescript", "tsx", "html", "css"]
PARSERS = {lang: "code" if lang in CODE_LANGUAGES else lang if lang in ("markdown", "pdf", "yaml", "toml", "json") else "plaintext" for lang in LANGUAGES}
