"""Word lists and lookup tables that results depend on."""

# Language by file extension.
EXT_LANG = {
    "rs": "rust", "c": "c", "h": "c", "cpp": "c++", "cc": "c++", "cxx": "c++", "hpp": "c++",
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "py": "python", "go": "go", "java": "java", "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sass": "css", "less": "css", "sql": "sql", "sh": "bash", "bash": "bash",
    "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "markdown": "markdown", "txt": "text",
    "rb": "ruby", "swift": "swift", "kt": "kotlin", "cs": "csharp", "lua": "lua", "zig": "zig", "vue": "vue", "svelte": "svelte",
    "graphql": "graphql", "gql": "graphql", "proto": "protobuf", "xml": "xml", "ini": "ini", "cfg": "config", "conf": "config", "env": "env",
}

# Languages that belong to the text domain.
TEXT_LANGS = ["markdown", "text", "config", "ini", "env", "gitignore"]

# Display names by extension (case matters here).
EXT_DISPLAY = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript",
    "ts": "TypeScript", "tsx": "TypeScript", "go": "Go", "c": "C", "h": "C",
    "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "java": "Java", "cs": "C#", "rb": "Ruby", "php": "PHP",
    "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "zig": "Zig", "lua": "Lua", "sh": "Bash", "bash": "Bash", "sql": "SQL",
    "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML",
    "md": "Markdown", "markdown": "Markdown",
}

# Bytes per token by language; anything else has 3.2.
CHARS_PER_TOKEN = {
    "rust": 2.6, "c": 2.6, "c++": 2.6, "cpp": 2.6, "java": 2.6, "csharp": 2.6,
    "go": 2.8, "swift": 2.8, "kotlin": 2.8, "zig": 2.8, "javascript": 2.9, "typescript": 2.9,
    "python": 3.4, "ruby": 3.4, "lua": 3.4, "html": 3.0, "xml": 3.0, "css": 3.0, "scss": 3.0, "sql": 3.0, "graphql": 3.0,
    "bash": 3.0, "sh": 3.0, "markdown": 3.8, "md": 3.8, "text": 3.8,
}
DEFAULT_CHARS_PER_TOKEN = 3.2

# Marks of what a line-window chunk contains, in order of the tags.
LINE_TAGS = [
    ("functions", ["fn ", "def ", "function ", "func "]),
    ("types", ["struct ", "class ", "interface "]),
    ("enums", ["enum "]),
    ("impl", ["impl "]),
    ("traits", ["trait "]),
    ("tests", ["#[test]", "#[cfg(test)]", "def test_", "describe(", "@Test", "@test"]),
    ("imports", ["use ", "import ", "require(", "#include"]),
    ("error_handling", ["Error", "Result<", "unwrap(", "expect(", "panic!", "try ", "catch ", "except "]),
]

# Marks of what a scope chunk contains, in order of the tags.
SCOPE_TAGS = [
    ("functions", ["fn ", "def ", "function ", "func "]),
    ("types", ["struct ", "class ", "interface "]),
    ("enums", ["enum "]),
    ("impl", ["impl "]),
    ("traits", ["trait "]),
    ("imports", ["use ", "import ", "require(", "#include"]),
    ("declarations", ["const ", "static ", "let "]),
    ("tests", ["#[test]", "#[cfg(test)]", "def test_", "@Test", "@test", "describe(", "it(", "test("]),
    ("error_handling", ["Error", "Result<", "unwrap(", "expect(", "panic!", "try ", "catch ", "except ", "raise "]),
]

# Strings that are control tokens in a chat template.
SPECIAL_STRINGS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>", "<start_of_turn>", "<end_of_turn>"]

# Names of the tools.
TOOL_NAMES = ["run_bash", "run_python", "save_tool", "run_tool", "rag_search", "read_file", "write_file", "edit_file", "list_dir", "glob_files", "grep_files"]

# Words that a query doesn't score by.
STOP_WORDS = [
    "the", "and", "for", "this", "that", "with", "from", "are", "was", "not", "but", "can", "will", "has", "had", "its", "all", "any", "let",
    "mut", "pub", "use", "mod", "ref", "str", "self", "true", "false", "crate", "super", "where", "i32", "u32", "i64", "u64", "f32", "f64",
    "usize", "bool", "fn", "impl", "struct", "enum", "type", "const", "var", "val", "new", "return", "if", "else", "while", "in", "to", "of",
    "is", "it", "be", "as", "do",
]

# What the workspace walk admits and skips.
WORKSPACE_EXTS = [
    "ts", "tsx", "js", "jsx", "rs", "c", "cpp", "h", "hpp", "py", "go", "java", "html", "css", "sql", "sh", "bash", "toml", "yaml", "yml",
    "json", "md", "txt", "rb", "swift", "kt", "cs", "lua", "zig", "asm", "s", "vue", "svelte", "astro", "graphql", "gql", "proto", "cmake",
    "mk", "xml", "ini", "cfg", "conf", "hbs", "ejs", "pug", "scss", "sass", "less", "styl", "wat",
]
WORKSPACE_FILES = ["makefile", "dockerfile", "cmakelists.txt", ".gitignore", ".env"]
WORKSPACE_SKIP = [
    ".git", "target", "node_modules", "dist", "build", "out", "__pycache__", ".venv", "venv", "data", "models", ".idea", ".vscode", "bin",
    "obj", "vendor", ".next", "coverage",
]
WORKSPACE_DEPTH = 16
#: Of the walk that search tools and path indexing share (case matters).
TOOL_SKIP = [
    ".git", "node_modules", "target", "build", "dist", "out", "vendor", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache",
    ".idea", ".vscode", ".cargo", ".next", ".nuxt", "coverage",
]
TOOL_DEPTH = 24

# Reasoning efforts, weakest first.
EFFORTS = ["low", "medium", "xhigh", "einstein", "spoon"]

# MiB of key-value cache per token, by cache type.
KV_MIB = {"f16": 0.065, "": 0.065, "q8_0": 0.035, "q4_0": 0.020, "q4_1": 0.020, "q5_0": 0.020, "q5_1": 0.020}
DEFAULT_KV_MIB = 0.035
