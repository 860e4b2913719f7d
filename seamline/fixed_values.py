"""Names, limits and tables that decide which rows a job returns."""

# Fixed values -----------------------------------------------------------------

MODEL_NAME = "onnx-community/embeddinggemma-300m-ONNX"
EMBEDDING_DIMS = (768, 512, 256, 128)
EMBEDDING_DIM = 768
CHUNK_SIZE_LINES = 64
CHUNK_OVERLAP_LINES = 16
BATCH_SIZE = 32
TOP_K = 10
MAX_TOKENS = 2048
MTIME_TOLERANCE = 0.001

DOCUMENT_PREFIX = "title: none | text: "
QUERY_PREFIX = "task: search result | query: "
PREVIEW_GAP = "    ..."
INDENT = "    "
READ_ERROR = "[Error reading file: %s]"

INCLUDE_EXTENSIONS = (
    ".c", ".h", ".cpp", ".cc", ".py", ".js", ".ts", ".tsx", ".jsx", ".rs",
    ".go", ".java", ".scala", ".cs", ".php", ".rb", ".sh", ".sql", ".html",
    ".css", ".json", ".yaml", ".yml",
)

STORE_FOLDER = ".seamline"

EXCLUDED_FOLDERS = (
    ".git", STORE_FOLDER, "node_modules", "__pycache__", ".venv", "venv",
    ".env", "dist", "build", ".next", ".nuxt", "target", "bin", "obj",
)

LANGUAGES = {
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".scala": "scala",
    ".cs": "csharp",
    ".php": "php",
    ".rb": "ruby",
    ".sh": "shell",
    ".bash": "shell",
    ".sql": "sql",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".md": "markdown",
    ".txt": "text",
}
