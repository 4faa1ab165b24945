"""Which technologies go together."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

LANGUAGE_FRAMEWORKS = {
    "Python": ["Django", "Flask", "FastAPI", "PyTorch", "TensorFlow", "Pandas", "NumPy"],
    "JavaScript": ["React", "Vue.js", "Angular", "Express", "Next.js", "Node.js", "jQuery"],
    "TypeScript": ["React", "Vue.js", "Angular", "Express", "Next.js", "Node.js"],
    "Java": ["Spring", "Hibernate", "Jakarta EE", "Maven", "Gradle"],
    "C#": ["ASP.NET", "Entity Framework", ".NET", "Blazor"],
    "PHP": ["Laravel", "Symfony", "CodeIgniter", "Composer"],
    "Ruby": ["Rails", "Sinatra", "RubyGems", "Bundler"],
    "Go": ["Gin", "Echo", "Fiber", "Gorilla", "Go Modules"],
}

LANGUAGE_BUILD_TOOLS = {
    "Python": ["setuptools", "pip", "Poetry", "Pipenv", "Conda"],
    "JavaScript": ["npm", "Yarn", "Webpack", "Babel", "Rollup", "esbuild", "swc"],
    "TypeScript": ["npm", "Yarn", "Webpack", "Babel", "Rollup", "tsc", "esbuild", "swc"],
    "Java": ["Maven", "Gradle", "Ant"],
    "C#": ["MSBuild", "NuGet"],
    "PHP": ["Composer"],
    "Ruby": ["Bundler", "RubyGems", "Rake"],
    "Go": ["Go Modules"],
}

FRAMEWORK_DATABASES = {
    "Django": ["PostgreSQL", "SQLite", "MySQL"],
    "Rails": ["PostgreSQL", "SQLite", "MySQL"],
    "Laravel": ["MySQL", "PostgreSQL"],
    "Express": ["MongoDB", "MySQL", "PostgreSQL"],
    "Spring": ["PostgreSQL", "MySQL", "Oracle", "SQL Server"],
    "Flask": ["SQLite", "PostgreSQL", "MySQL"],
}
