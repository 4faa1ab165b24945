"""Build system and package manager rules."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

BUILD_FILES = {
    "Maven": ["pom.xml"],
    "Gradle": [
        "build.gradle", "build.gradle.kts", "settings.gradle", "gradle.properties", "gradlew",
    ],
    "Ant": ["build.xml"],
    "Make": ["Makefile", "makefile", "GNUmakefile"],
    "CMake": ["CMakeLists.txt", "cmake"],
    "Bazel": ["BUILD", "WORKSPACE", ".bazelrc"],
    "MSBuild": [".csproj", ".vbproj", ".vcxproj", ".sln"],
    "Webpack": ["webpack.config.js", "webpack.config.ts", "webpack.common.js"],
    "Vite": ["vite.config.js", "vite.config.ts"],
    "Rollup": ["rollup.config.js", "rollup.config.ts"],
    "Parcel": [".parcelrc", "parcel.config.js"],
    "Gulp": ["gulpfile.js", "gulpfile.ts"],
    "Grunt": ["Gruntfile.js"],
    "Rake": ["Rakefile"],
    "SCons": ["SConstruct", "SConscript"],
    "Buck": ["BUCK", ".buckconfig"],
    "Pants": ["pants", "pants.ini"],
    "setuptools": ["setup.py"],
    "Meson": ["meson.build"],
    "Ninja": ["build.ninja"],
    "esbuild": ["esbuild.config.js"],
    "swc": [".swcrc"],
    "Babel": [".babelrc", "babel.config.js"],
    "tsc": ["tsconfig.json"],
    "Rome": ["rome.json"],
    "Snowpack": ["snowpack.config.js", "snowpack.config.mjs"],
}

PACKAGE_FILES = {
    "npm": ["package.json", "package-lock.json", "node_modules/"],
    "Yarn": ["yarn.lock", ".yarnrc", ".yarnrc.yml"],
    "pnpm": ["pnpm-lock.yaml", ".pnpmfile.cjs"],
    "Bower": ["bower.json", ".bowerrc"],
    "pip": ["requirements.txt", "setup.py", "pyproject.toml"],
    "Pipenv": ["Pipfile", "Pipfile.lock"],
    "Poetry": ["pyproject.toml", "poetry.lock"],
    "Conda": ["environment.yml", "conda-env.yml", "meta.yaml"],
    "RubyGems": ["Gemfile", "Gemfile.lock", ".gemspec"],
    "Bundler": ["Gemfile", "Gemfile.lock"],
    "CocoaPods": ["Podfile", "Podfile.lock", ".podspec"],
    "Carthage": ["Cartfile", "Cartfile.resolved"],
    "Composer": ["composer.json", "composer.lock"],
    "NuGet": ["packages.config", ".nuspec", ".nupkg", "paket.dependencies"],
    "Cargo": ["Cargo.toml", "Cargo.lock"],
    "Go Modules": ["go.mod", "go.sum"],
    "Dep": ["Gopkg.toml", "Gopkg.lock"],
    "Maven": ["pom.xml"],
    "Gradle": ["build.gradle", "build.gradle.kts"],
    "Ivy": ["ivy.xml"],
    "Leiningen": ["project.clj"],
    "sbt": ["build.sbt"],
    "rebar": ["rebar.config"],
    "hex": ["mix.exs", "mix.lock"],
    "dpkg": ["debian/"],
    "RPM": ["SPECS/", ".spec"],
    "Pacman": ["PKGBUILD"],
    "Swift Package Manager": ["Package.swift"],
    "vcpkg": ["vcpkg.json"],
    "Conan": ["conanfile.txt", "conanfile.py"],
}

BUILD_CONTENT = {
    "Maven": [
        r'<project\s+xmlns=\"http://maven\.apache\.org/POM', "<groupId>.*?</groupId>",
        "<artifactId>.*?</artifactId>", r"mvn\s+(?:clean|compile|package|install|deploy)",
    ],
    "Gradle": [
        r"apply\s+plugin:", r"plugins\s*{", r"repositories\s*{", r"dependencies\s*{",
        'implementation\\s+[\\\'\\"]', r"gradle\s+(?:clean|build|assemble|check)",
    ],
    "MSBuild": [
        r'<Project\s+Sdk=\"Microsoft\.NET\.Sdk', "<PropertyGroup>", "<TargetFramework>",
        r"<PackageReference\s+",
    ],
    "Webpack": [
        r"module\.exports\s*=", r"const\s+webpack\s*=\s*require", r"entry\s*:", r"output\s*:",
        r"module\s*:\s*{\s*rules\s*:",
    ],
    "setuptools": [
        r"from\s+setuptools\s+import", r"setup\(", r"packages\s*=", r"install_requires\s*=",
    ],
    "tsc": [
        r'\"compilerOptions\"\s*:', r'\"target\"\s*:', r'\"module\"\s*:', r'\"outDir\"\s*:',
        r'\"rootDir\"\s*:',
    ],
    "Babel": [
        r'\"presets\"\s*:', r'\"plugins\"\s*:', "babel-preset-", "@babel/preset-", "@babel/plugin-",
    ],
}

PACKAGE_CONTENT = {
    "npm": [
        r'\"dependencies\"\s*:', r'\"devDependencies\"\s*:', r'\"scripts\"\s*:',
        r"npm\s+(?:install|ci|run)",
    ],
    "Yarn": [r"yarn\s+(?:add|remove|upgrade|install)", r'\"resolutions\"\s*:'],
    "pip": [r"pip\s+(?:install|freeze|download)", r"from\s+\w+\s+import", r"import\s+\w+"],
    "Cargo": [r"\[dependencies\]", r"\[dev-dependencies\]", r"cargo\s+(?:build|run|test|check)"],
    "Go Modules": [r"go\s+(?:build|run|test|mod)", r"import\s+\(", r"require\s+\("],
    "Composer": [
        r'\"require\"\s*:', r'\"require-dev\"\s*:', r"composer\s+(?:install|update|require)",
    ],
}

USAGE = {
    "Maven": [
        r"mvn\s+clean", r"mvn\s+compile", r"mvn\s+install", r"mvn\s+deploy", "./mvnw",
        r"mvn\s+package",
    ],
    "Gradle": [
        r"gradle\s+build", "./gradlew", "gradlew.bat", r"gradle\s+assemble", r"gradle\s+clean",
        r"gradle\s+test",
    ],
    "Make": [r"make\s+all", r"make\s+clean", r"make\s+install", r"make\s+test"],
    "npm": [
        r"npm\s+install", r"npm\s+ci", r"npm\s+run", r"npm\s+start", r"npm\s+test", r"npm\s+build",
    ],
    "Yarn": [
        r"yarn\s+install", r"yarn\s+add", r"yarn\s+run", r"yarn\s+start", r"yarn\s+test",
        r"yarn\s+build",
    ],
    "pip": [r"pip\s+install", r"pip\s+install\s+-r", r"python\s+-m\s+pip"],
    "Cargo": [r"cargo\s+build", r"cargo\s+run", r"cargo\s+test"],
    "Go Modules": [r"go\s+build", r"go\s+install", r"go\s+run", r"go\s+test"],
}

# Pairs of first-level directories that mark a frontend/backend split, best first.
SPLIT_DIRECTORIES = [
    ("frontend", "backend"),
    ("client", "server"),
    ("ui", "api"),
    ("app", "api"),
    ("web", "api"),
]
