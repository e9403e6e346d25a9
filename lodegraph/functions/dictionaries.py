"""Word lists, patterns and limits whose exact content decides results."""

from __future__ import annotations

# Language of an extension.
LANGUAGES = {
    "TypeScript": "ts tsx", "JavaScript": "js jsx mjs cjs", "Python": "py", "Go": "go", "Rust": "rs", "Java": "java", "Kotlin": "kt", "Ruby": "rb", "PHP": "php", "C#": "cs", "C++": "cpp", "C": "c h", "Swift": "swift",
    "Vue": "vue", "Svelte": "svelte", "Scala": "scala", "JSON": "json", "Markdown": "md", "YAML": "yml yaml", "TOML": "toml", "CSS": "css", "SCSS": "scss", "HTML": "html", "Shell": "sh", "Bash": "bash", "Zsh": "zsh",
    "Lua": "lua", "Perl": "perl pl", "Dart": "dart", "Elixir": "elixir exs ex", "Erlang": "erlang hrl", "Haskell": "haskell hs", "Clojure": "clojure clj", "ClojureScript": "cljs", "F#": "fsharp fs",
    "Objective-C": "objectivec mm", "MATLAB": "matlab m", "R": "r", "Julia": "julia jl", "Solidity": "solidity sol", "SQL": "sql", "GraphQL": "graphql gql", "Protocol Buffers": "proto", "Dockerfile": "dockerfile",
    "Makefile": "makefile", "CMake": "cmake", "COBOL": "cbl cob cpy", "Pascal": "pas pp inc",
}
EXTENSION_LANGUAGE = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}

# Extensions that have a language but are no source files.
NOT_SOURCE = "cmake css dockerfile elixir h html json makefile md scss toml yaml yml".split()
SOURCE_EXTENSIONS = sorted(set(EXTENSION_LANGUAGE) - set(NOT_SOURCE))

# Names of configuration files.
CONFIG_NAMES = (
    "package.json tsconfig.json cargo.toml pyproject.toml requirements.txt go.mod pom.xml build.gradle vite.config.ts vite.config.js next.config.js next.config.ts webpack.config.js .eslintrc.json tailwind.config.js "
    "tailwind.config.ts pnpm-workspace.yaml turbo.json nx.json go.work lerna.json"
).split()

# Paths of entry points.
ENTRYPOINTS = [r"^src/(main|index)\.(ts|tsx|js|jsx)$", r"^src/routes/__root\.(ts|tsx)$", r"^main\.(py|go)$", r"^cmd/[^/]+/main\.go$", r"^index\.(html|js|ts)$"]

# What counts as a decision, with @ for a word boundary.
COMPLEXITY = [r"@if@", r"@else\s+if@", r"@for@", r"@while@", r"@case@", r"@catch@", r"\?\s*[^:]*:", r"&&", r"\|\|"]

ELSE_IF, CONDITIONAL = COMPLEXITY[1], COMPLEXITY[6]

# Import patterns of a language in order, with @ for a word boundary; the last item says which specs are relative.
_QUOTED = r"""["']([^"']+)["']"""
IMPORTS: list[tuple[str, list[str], str]] = [
    ("ts tsx js jsx mjs cjs vue svelte", [rf"@import\s+(?:[\w*{{}}\s,]+\s+from\s+)?{_QUOTED}", rf"@require\s*\(\s*{_QUOTED}\s*\)", rf"@import\s*\(\s*{_QUOTED}\s*\)", rf"@export\s+(?:\*|\{{[^}}]*\}})\s+from\s+{_QUOTED}"], "./"),
    ("py", [r"(?m)^\s*from\s+([\w.]+)\s+import@", r"(?m)^\s*import\s+([\w.]+)"], "."),
    ("rs", [r"@use\s+([\w:]+)\s*;", r"@extern\s+crate\s+([\w]+)\s*;"], "./::"),
    ("java", [r"@import\s+([\w.]+)\s*;"], "."),
    ("kt", [r"@import\s+([\w.]+)\s*"], "."),
    ("rb ruby", [rf"@require\s+{_QUOTED}", rf"@require_relative\s+{_QUOTED}"], "./"),
    ("php phtml", [rf"@require\s+{_QUOTED}", rf"@require_once\s+{_QUOTED}", rf"@include\s+{_QUOTED}", rf"@include_once\s+{_QUOTED}"], "./"),
    ("cs", [r"@using\s+([\w.]+)\s*;"], ""),
    ("c cpp cc cxx h hpp hxx", [r"""#\s*include\s+[<"]([^>"]+)[>"]"""], "./"),
    ("swift", [r"@import\s+([\w.]+)"], ""),
    ("scala", [r"@import\s+([\w.]+)\s*"], "."),
    ("dart", [rf"@import\s+{_QUOTED}\s*;"], "./package:"),
    ("lua", [rf"@require\s*\(\s*{_QUOTED}\s*\)"], "./"),
    ("ex exs", [r"@require\s+([\w.]+)", r"@import\s+([\w.]+)"], "."),
    ("erl hrl", [r"@-import\s*\(\s*([\w,]+)\s*\)"], ""),
    ("hs", [r"@import\s+([\w.]+)\s*"], ""),
    ("clj", [r"\(:require\s+\[([^\]]+)\]"], "."),
    ("fs", [r"@open\s+([\w.]+)"], ""),
    ("sql", [rf"@--\s*#include\s+{_QUOTED}"], "./"),
    ("html htm", [rf"(?i)src={_QUOTED}", rf"(?i)href={_QUOTED}"], "*"),
]
# Go's imports, one by one and in blocks.
GO_SINGLE, GO_BLOCK, GO_ITEM = r'@import\s+"([^"]+)"', r"(?s)@import\s*\((.*?)\)", r'"([^"]+)"'

# What an import's path may be completed with, in order.
CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ".py", "/__init__.py", ".go"]

# Function patterns of an extension in order: name, then parameters; the last item marks patterns of methods.
_JS_FN = [r"function\s+([a-zA-Z_$][\w$]*)\s*\(([^)]*)\)\s*\{", r"(?:const|let|var)\s+([a-zA-Z_$][\w$]*)\s*=\s*\(([^)]*)\)\s*=>"]
FUNCTIONS: dict[str, list[tuple[str, bool]]] = {
    "ts": [*((p, False) for p in _JS_FN), (r"([a-zA-Z_$][\w$]*)\s*\(([^)]*)\)\s*\{", False)],
    "js": [(p, False) for p in _JS_FN],
    "py": [(r"def\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*:", False)],
    "go": [(r"func\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*[^{]*\{", False), (r"func\s*\([^)]+\)\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*[^{]*\{", True)],
    "rs": [(r"fn\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*(?:->\s*[^{]+)?\s*\{", False)],
    "java": [(r"(?:public|private|protected|static|final|native|synchronized|\s)\s*[\w<>\[\]\s]+\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*\{", False)],
    "c": [(r"[\w\s*]+\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*\{", False)],
    "cpp": [(r"[\w:\s<>]+\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*(?:const)?\s*\{", False)],
    "php": [(r"function\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*\{", False), (r"(?:public|private|protected|static|final|abstract|\s)\s+function\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*\{", True)],
    "rb": [(r"def\s+([a-zA-Z_][\w?]*)\s*\(?([^)]*)\)?", False)],
    "swift": [(r"func\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*(?:->\s*[^{]+)?\s*\{", False)],
    "kt": [(r"fun\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*(?::\s*[^{]+)?\s*\{", False)],
    "scala": [(r"def\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*(?::\s*[^=]+)?\s*=", False)],
}
# The literal form of the Java pattern, which no ordinary method matches.
JAVA_LITERAL = r"(?:public|private|protected|static|final|native|synchronized|\s)\s*[\w<>\[]\s\]+\s+([a-zA-Z_][\w]*)\s*\(([^)]*)\)\s*\{"
# Other names of the lists, by language.
FUNCTIONS_OF = {"h": "c", "hxx": "", "tsx": "", "jsx": "", "mjs": "", "cjs": ""}

# Call patterns of an extension in order.
_D, _W = r"([a-zA-Z_$][\w$]*)\s*\(", r"([a-zA-Z_][\w]*)\s*\("
_JS_CALLS = [_D, r"this\.([a-zA-Z_$][\w$]*)\s*\(", r"[a-zA-Z_$][\w$]*\.([a-zA-Z_$][\w$]*)\s*\("]
CALLS: dict[str, list[str]] = {
    "ts": _JS_CALLS,
    "js": _JS_CALLS,
    "py": [_W, r"self\.([a-zA-Z_][\w]*)\s*\(", r"[a-zA-Z_][\w]*\.([a-zA-Z_][\w]*)\s*\("],
    "go": [_W, r"[a-zA-Z_][\w]*\.([a-zA-Z_][\w]*)\s*\("],
    "rs": [_W, r"self\.([a-zA-Z_][\w]*)\s*\("],
    "java": [_W, r"this\.([a-zA-Z_][\w]*)\s*\(", r"[a-zA-Z_][\w]*\.([a-zA-Z_][\w]*)\s*\("],
    "c": [_W],
    "cpp": [_W, r"[a-zA-Z_][\w]*::([a-zA-Z_][\w]*)\s*\("],
    "php": [_W, r"this->([a-zA-Z_][\w]*)\s*\(", r"[a-zA-Z_][\w]*->([a-zA-Z_][\w]*)\s*\("],
    "rb": [r"([a-zA-Z_][\w?]*)\s*\(", r"[a-zA-Z_][\w?]*\.([a-zA-Z_][\w?]*)\s*\("],
    "swift": [_W, r"self\.([a-zA-Z_][\w]*)\s*\("],
    "kt": [_W, r"this\.([a-zA-Z_][\w]*)\s*\("],
    "scala": [_W, r"this\.([a-zA-Z_][\w]*)\s*\("],
}
# Not fixed, of this package's own making: comments and short literals of brace languages; definitions; and names before a parenthesis with their dot.
REMARK = r"""(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
DEFINITION = r"(?:function|func|fn|def)\s+[A-Za-z_$][\w$]*\s*\("
CALLED = r"(\.?[A-Za-z_$][\w$]*)\s*\("
BRACES = "ts tsx js jsx mjs cjs java go rs c cpp".split()

# Words before a parenthesis that are no calls.
NO_CALLS = (
    "if else for while do switch case return new delete typeof instanceof void throw try catch finally with var let const function class import export from as default break continue debugger public private protected static final "
    "abstract native synchronized volatile transient strictfp interface implements extends super this null true false undefined NaN Infinity eval parseInt parseFloat isNaN isFinite decodeURI encodeURI decodeURIComponent encodeURIComponent"
).split()

# Words that are no callees where the structure is read.
TREE_KEYWORDS = set(
    "if else for while do switch case return new delete typeof instanceof void throw try catch finally with var let const function class import export from as default break continue debugger super this null true false undefined NaN Infinity eval".split()
)

# Limits of scans, and directories and extensions left out.
MAX_FILES, MAX_FILES_API, MAX_BYTES, WARNINGS_KEPT, TOP = 1900, 2000, 200_000, 5, 5
LOCAL_SKIPPED = ["node_modules", ".git", "dist", "build"]
UPLOAD_SKIPPED_DIRS = ["/node_modules/", "/.git/", "/dist/", "/.next/"]
UPLOAD_SKIPPED_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "mp4", "pdf", "zip", "exe", "dll"]
ASSET_ENDINGS = [".js", ".css", ".jsx", ".ts"]

# Thresholds and names of contracts.
CRITICAL_COMPLEXITY, CRITICAL_DEGREE, WARNING_COMPLEXITY, HOT_DEGREE = 100, 30, 50, 25
SKILLS = {"python": "Karpathy_Python_Strict_Typing_Skill", "typescript": "Enterprise_TS_Modularization_Skill", "javascript": "Enterprise_TS_Modularization_Skill"}
SKILL_ELSE = "Standard_Clean_Architecture_Skill"
DIRECTIVES = {
    "STABLE": ["Execute otimizações locais mantendo a coesão do módulo.", "Valide a integridade de compilação antes de finalizar."],
    "WARNING": ["ATENÇÃO: Módulo com densidade lógica intermediária.", "DIRETRIZ: Isole efeitos colaterais e garanta que as tipagens estejam estritamente definidas."],
    "CRITICAL_GOD_MODULE": [
        "CRÍTICO: Este componente é um Módulo Deus (God Module) de alto acoplamento.",
        "OBRIGATÓRIO: Quebre blocos condicionais aninhados (if/else/switch) em funções puras independentes.",
        "PLANO DE AÇÃO: Reduza a complexidade ciclomática dividindo responsabilidades sem alterar o comportamento externo.",
        "RESTRIÇÃO ABSOLUTA: Não adicione novas lógicas de negócio; foque estritamente na refatoração estrutural prescrita.",
    ],
}
PROTECTED = ["initializeEngine", "parseAST"]

# Names that the synthetic source draws from are in sources.synthetic.


def java(pattern: str) -> str:
    """A pattern with @ as an ASCII word boundary, which \\b isn't in every Java."""
    b = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace("@", b)


def re2(pattern: str) -> str:
    """The same for engines whose \\b is ASCII."""
    return pattern.replace("@", r"\b")
