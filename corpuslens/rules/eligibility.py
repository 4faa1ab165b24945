"""Which files are read."""

# What a scan skips and what it loads.

EXCLUDED_DIRECTORIES = [
    ".git", "node_modules", "venv", ".venv", "__pycache__", "build", "dist", "target", "bin", "obj",
]
CONTENT_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".rs", ".c", ".cpp",
    ".swift", ".kt", ".scala", ".sh", ".bash", ".ps1", ".html", ".css", ".scss", ".less", ".vue",
    ".svelte", ".json", ".yml", ".yaml", ".xml", ".toml", ".ini", ".conf", ".properties", ".gradle",
    ".lock", ".mod", ".sum", ".csproj", ".sln",
]
CONTENT_NAMES = [
    "Gemfile", "Rakefile", "Dockerfile", "Makefile", "requirements.txt", "package.json",
    "composer.json", "pom.xml", "build.gradle", ".gitignore", ".dockerignore",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".jar", ".class", ".pyc",
    ".pyd", ".so", ".dll", ".exe", ".bin", ".dat", ".db", ".sqlite", ".o", ".obj", ".a", ".lib",
    ".dylib", ".iso", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".wav", ".ogg", ".woff",
    ".woff2", ".ttf", ".eot", ".svg",
]
