"""Languages by file extension and by file name."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

EXTENSIONS = {
    ".py": "Python",
    ".ipynb": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "React/JavaScript",
    ".tsx": "React/TypeScript",
    ".java": "Java",
    ".class": "Java",
    ".jar": "Java",
    ".cs": "C#",
    ".csproj": "C#",
    ".vb": "Visual Basic",
    ".go": "Go",
    ".rb": "Ruby",
    ".php": "PHP",
    ".rs": "Rust",
    ".c": "C",
    ".h": "C",
    ".cpp": "C++",
    ".hpp": "C++",
    ".cc": "C++",
    ".hh": "C++",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".clj": "Clojure",
    ".erl": "Erlang",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".elm": "Elm",
    ".fs": "F#",
    ".fsx": "F#",
    ".hs": "Haskell",
    ".lhs": "Haskell",
    ".pl": "Perl",
    ".r": "R",
    ".lua": "Lua",
    ".m": "Objective-C",
    ".mm": "Objective-C++",
    ".jl": "Julia",
    ".sh": "Shell",
    ".bash": "Bash",
    ".zsh": "Zsh",
    ".ps1": "PowerShell",
    ".psm1": "PowerShell",
    ".bat": "Batch",
    ".cmd": "Batch",
    ".html": "HTML",
    ".htm": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "Sass",
    ".less": "LESS",
    ".vue": "Vue.js",
    ".svelte": "Svelte",
    ".jsp": "JSP",
    ".asp": "ASP",
    ".aspx": "ASP.NET",
    ".sql": "SQL",
    ".hql": "HQL",
    ".xml": "XML",
    ".xsl": "XSL",
    ".xslt": "XSLT",
    ".json": "JSON",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".toml": "TOML",
    ".ini": "INI",
    ".md": "Markdown",
    ".rst": "reStructuredText",
    ".tex": "LaTeX",
    ".proto": "Protocol Buffers",
    ".gradle": "Gradle",
    ".groovy": "Groovy",
    ".dart": "Dart",
    ".d": "D",
    ".coffee": "CoffeeScript",
    ".tf": "Terraform",
    ".hcl": "HCL",
}

SPECIAL_FILES = {
    "package.json": "JavaScript/Node.js",
    "tsconfig.json": "TypeScript",
    "requirements.txt": "Python",
    "setup.py": "Python",
    "Pipfile": "Python",
    "pyproject.toml": "Python",
    "Gemfile": "Ruby",
    "Rakefile": "Ruby",
    "pom.xml": "Java",
    "build.gradle": "Java/Kotlin",
    "composer.json": "PHP",
    "Cargo.toml": "Rust",
    "go.mod": "Go",
    "build.sbt": "Scala",
    "mix.exs": "Elixir",
    "cabal.project": "Haskell",
    "stack.yaml": "Haskell",
    "dub.json": "D",
    "CMakeLists.txt": "C/C++",
    "Makefile": "Make",
    "pubspec.yaml": "Dart",
}
