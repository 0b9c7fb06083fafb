"""What files are called and how they begin. All tables here are fixed values: results depend on each entry."""

from __future__ import annotations

SOURCE_GLOBS = (
    "**/*.{js,jsx,ts,tsx,mjs,cjs,mts,cts}",
    "**/*.{py,pyi,pyw}",
    "**/*.{cs,csx,fs,fsx,fsi,vb}",
    "**/*.{java,kt,kts,scala,groovy}",
    "**/*.{c,cc,cpp,cxx,h,hh,hpp,hxx,ixx,inl,tpp}",
    "**/*.{go,rs,zig}",
    "**/*.{lua,rb,php,pl,pm}",
    "**/*.{sql,proto,graphql,gql}",
    "**/*.{sh,bash,zsh,fish,ps1,psm1,psd1}",
)
EVIDENCE_GLOBS = (
    "**/*.{json,jsonc,yaml,yml,toml,ini,conf,config}",
    "**/*.{log,jsonl,ndjson,out}",
    "**/*.{md,mdx,rst,adoc,txt}",
    "**/.env.example",
    "**/.env.sample",
    "**/.env.template",
    "**/README.md",
    "**/CHANGELOG.md",
    "**/CONTRIBUTING.md",
    "**/ARCHITECTURE.md",
    "**/DECISIONS.md",
    "**/ADR*.md",
)
MANIFEST_GLOBS = (
    "**/package.json",
    "**/package-lock.json",
    "**/pnpm-lock.yaml",
    "**/yarn.lock",
    "**/bun.lockb",
    "**/pyproject.toml",
    "**/requirements*.txt",
    "**/Pipfile",
    "**/Pipfile.lock",
    "**/poetry.lock",
    "**/Cargo.toml",
    "**/Cargo.lock",
    "**/go.mod",
    "**/go.sum",
    "**/*.csproj",
    "**/*.fsproj",
    "**/*.vbproj",
    "**/*.sln",
    "**/pom.xml",
    "**/build.gradle",
    "**/build.gradle.kts",
    "**/settings.gradle",
    "**/settings.gradle.kts",
    "**/gradle.properties",
    "**/CMakeLists.txt",
    "**/*.cmake",
    "**/Makefile",
    "**/GNUmakefile",
    "**/meson.build",
    "**/WORKSPACE",
    "**/WORKSPACE.bazel",
    "**/BUILD",
    "**/BUILD.bazel",
    "**/*.uproject",
    "**/*.uplugin",
)
IGNORED = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "bower_components", "dist", "build", "coverage", ".nyc_output", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", ".parcel-cache", ".vite", ".vercel", ".output",
    ".angular", ".astro", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", ".gradle", ".terraform", ".serverless", ".aws-sam", "target", "bin", "obj", "out", "tmp", "temp", ".codex",
)
RULE_FILES = ("architecture-rules.json", "architecture-rules.yaml", "architecture-rules.yml")
GENERATED_GLOBS = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.turbo/**", "**/vendor/**", "**/generated/**", "**/__generated__/**", "**/.generated/**",
    "**/.openapi-generator/**", "**/.swagger-codegen/**", "**/prisma/generated/**", "**/*.generated.*", "**/*.gen.*", "**/*.g.*", "**/*.designer.*", "**/*.pb.*", "**/*.grpc.*", "**/*.g.cs", "**/*.designer.cs",
    "**/*.generated.cs", "**/*.generated.h", "**/*.generated.cpp", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.snap", "**/*.d.ts", "**/*.d.mts", "**/*.d.cts",
)
BANNERS = (r"@generated\b", r"\bauto-generated\b", r"\bautomatically generated\b", r"\bgenerated by\b", r"\bdo not edit\b", r"\bdo not modify\b")
BANNER_WORDS = ("generated", "do not edit", "do not modify")  # one is in each banner
BINARY = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "tif", "tiff", "pdf", "zip", "gz", "tar", "7z", "rar", "woff", "woff2", "ttf", "otf", "mp3", "mp4", "wav", "ogg", "mov", "avi", "dll", "so", "dylib", "exe", "class",
)
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "pyi": "python",
    "cs": "csharp", "fs": "fsharp", "vb": "vbnet",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala",
    "go": "go", "rs": "rust",
    "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hxx": "cpp", "ixx": "cpp",
    "lua": "lua", "rb": "ruby", "php": "php", "sql": "sql",
    "proto": "protobuf", "graphql": "graphql", "gql": "graphql",
    "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "markdown", "mdx": "markdown",
    "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell",
    "ps1": "powershell", "psm1": "powershell", "psd1": "powershell",
}
TEST_GLOBS = (
    "**/*.{test,spec}.{js,jsx,ts,tsx,mjs,cjs,mts,cts}",
    "**/test_*.py",
    "**/*_test.py",
    "**/*_test.go",
    "**/*Test.java",
    "**/*Tests.java",
    "**/*Test.kt",
    "**/*Tests.kt",
    "**/*Test.cs",
    "**/*Tests.cs",
    "**/tests/**/*.rb",
    "**/spec/**/*.rb",
)
TEST_FOLDER = r"(^|/)(tests?|__tests__|spec)/"
TEST_MARK = r"(?i)(describe\s*\(|it\s*\(|test\s*\(|pytest|unittest|xunit|nunit|mstest)"
# The same in two parts that are quicker to find: words, and calls by their last letter
TEST_WORDS = ("pytest", "unittest", "xunit", "nunit", "mstest")
TEST_CALL = r"(?i)[et](?=\s*\()(?<=describe|it|test)"
DOCS = ("md", "mdx", "rst", "adoc", "txt")
DOC_FOLDER = r"(^|/)(docs?|adr|architecture|decision)s?(/|$)"
CONFIGS = ("json", "jsonc", "yaml", "yml", "toml", "ini", "conf", "config")
CONFIG_NAMES = ("dockerfile", "makefile", "cmakelists.txt")
CONFIG_WORD = r"config|settings|compose|workspace|project"
CONFIG_MARK = r'''(?i)("scripts"\s*:|\[tool\.|<project>|plugins\s*\{|services\s*:|apiVersion\s*:)'''
CONFIG_WORDS = ('"scripts"', "[tool.", "<project>", "plugins", "services", "apiversion")  # one is in each mark
LEVEL_WORD = r"(?i)(trace|debug|info|warn|error|fatal)"
LOG_FILES = ("log-intel.json", "log-intel.yaml", "log-intel.yml")
LOG_FOLDERS = ("logs", "log", "var/log")
LOG_EXTENSIONS = ("log", "jsonl", "ndjson", "out")
LOG_NAME = r"(?i)(access|error|server|app|api|combined|requests?|runtime|events?)\.(log|txt|jsonl|ndjson|out)$"
LOG_LINE = r"^(\S+)\s+([A-Z]+)\s+([a-zA-Z0-9._-]+)\s+(.*)$"
LOG_FIELDS = {"timestamp": ("timestamp", "time"), "level": ("level", "lvl"), "service": ("service", "serviceName"), "message": ("message", "msg")}
IMPORT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
# Lua: names, what declares a table, a function or a member, what brings a module in, and words before a parenthesis that are no call
LUA_NAME = r'''[A-Za-z_][A-Za-z0-9_]*'''
LUA_PATH = rf'''{LUA_NAME}(?:\.{LUA_NAME})*'''
LUA_TABLE = rf'''^\s*(local\s+)?({LUA_NAME})\s*=\s*(?:\{{\s*\}}|Create(?:AndInit)?FromMixins\b.*|setmetatable\b.*)$'''
LUA_FUNCTION = rf'''^\s*(local\s+)?function\s+({LUA_NAME})\s*\('''
LUA_MEMBER = rf'''^\s*function\s+({LUA_PATH})[:.]({LUA_NAME})\s*\('''
LUA_ASSIGNED_MEMBER = rf'''^\s*({LUA_PATH})[:.]({LUA_NAME})\s*=\s*function\s*\('''
LUA_REQUIRE = r'''require\s*\(\s*["']([^"']+)["']\s*\)'''
LUA_LOOKED_UP = r'''[:.]GetModule\s*\(\s*["']([^"']+)["']\s*\)'''
LUA_WORDS = ("function", "if", "for", "while", "return", "local")
# Tests: calls that hold cases, calls that are cases, and the frameworks that imports tell
SUITE_CALLS = ("describe", "test.describe")
CASE_CALLS = ("it", "test", "specify", "it.only", "it.skip", "test.only", "test.skip")
FRAMEWORKS = {"@playwright/test": "playwright", "vitest": "vitest", "@jest/globals": "jest", "jest": "jest"}
