"""Defaults, and the values that results depend on."""

# They decide results, so they are stated as they must be.
EXTENSIONS = (".cs", ".py", ".js", ".ts", ".html", ".css")
EXCLUDED_FOLDERS = (
    "obj", "debug", "release", "Properties", "bin", "node_modules", ".git", "__pycache__",
    "venv", ".venv", "env", ".env", "dist", "build",
)
CONTEXT_LENGTHS = (
    ("llama3", 8192),
    ("llama2", 4096),
    ("mistral", 8192),
    ("mixtral", 32768),
    ("qwen", 32768),
    ("phi3", 4096),
    ("gemma", 8192),
    ("qwen2", 32768),
    ("qwen2.5-coder", 32768),
    ("codellama", 16384),
    ("vicuna", 4096),
    ("wizardcoder", 16384),
)
DEFAULT_CONTEXT_LENGTH = 8192
CONTEXT_SHARE = 0.8
BYTES_PER_TOKEN = 4
CHUNK_SIZE = 200
FULL_PROMPT_CHUNKS = 2
CALL_TIMEOUT_SECONDS = 20
CALL_TRIES = 3
RETRY_PAUSE_SECONDS = 2
FILE_LIST_PAGE = 50
PER_COLLECTION_CAP = 20
COLLECTIONS = ("file_summaries", "classes", "functions", "dependencies")
SIMILAR_COLLECTIONS = ("functions", "classes", "file_summaries")
TYPE_TO_COLLECTION = {
    "class": "classes",
    "function": "functions",
    "dependency": "dependencies",
    "summary": "file_summaries",
}
NO_SUMMARY = "No summary available."
NO_DESCRIPTION = "No description available"
NO_ANALYSIS = "No analysis available for this file."
UNREADABLE_REPLY = "Could not analyze chunk"
CHUNK_ERROR_PREFIX = "Error during analysis: "
SUMMARY_ERROR_PREFIX = "Error generating summary: "
FILE_ERROR_PREFIX = "Error analyzing file: "
