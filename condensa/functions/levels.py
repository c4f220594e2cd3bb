"""Fixed values of the reducers: limits by level, markers, languages."""

LIGHT, MEDIUM, AGGRESSIVE = "light", "medium", "aggressive"
LEVELS = (LIGHT, MEDIUM, AGGRESSIVE)
LEVEL_ALIASES = {"light": LIGHT, "l": LIGHT, "medium": MEDIUM, "m": MEDIUM, "aggressive": AGGRESSIVE, "a": AGGRESSIVE}
TYPES = ("code", "command_output", "conversation", "json", "mcp_schema", "unknown")

# One row for each limit, in the order light, medium, aggressive.
_TABLE = {
    "output_lines": (200, 80, 30),
    "output_similarity": (1.0, 0.9, 0.8),
    "test_failures": (10, 5, 3),
    "compiler_errors": (20, 10, 5),
    "file_lines": (100, 50, 20),
    "summary_over": (50, 10, 5),
    "signature_over": (None, 30, 10),
    "recent_turns": (5, 3, 2),
    "turn_score": (0.3, 0.5, 0.7),
    "turn_lines": (30, 15, 8),
    "json_depth": (5, 3, 2),
    "json_items": (10, 5, 3),
    "tool_schemas": (20, 10, 5),
    "tool_description": (500, 200, 80),
}
LIMITS = {name: dict(zip(LEVELS, row, strict=True)) for name, row in _TABLE.items()}

# File extensions by language.
EXTENSIONS = {
    "rust": ["rs"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "ruby": ["rb"],
    "php": ["php"],
    "swift": ["swift"],
    "kotlin": ["kt", "kts"],
    "csharp": ["cs"],
    "bash": ["sh", "bash", "zsh"],
}
# Marks of command output, roles that open a turn.
COMMAND_MARKS = ["warning:", "error:", "PASS", "FAIL", "ok ", "test ", "Compiling", "Downloading", "Installing", "running ", "✓", "✗", "●", "$", ">>>"]
ROLES = ["User:", "Assistant:", "Human:", "AI:", "user:", "assistant:"]
# Budget shares of a total by category.
BUDGET_TOTAL = 100_000
BUDGET_SHARES = {"conversation": 0.4, "tool_output": 0.3, "code": 0.2, "mcp": 0.1}


def parse_level(text: str) -> str:
    try:
        return LEVEL_ALIASES[text.lower()]
    except KeyError:
        raise ValueError(f"unknown level: {text}") from None


def parse_language(text: str) -> str:
    low = text.lower()
    named = {"rust", "typescript", "javascript", "python", "go", "java", "c", "cpp"}
    for name, ends in EXTENSIONS.items():
        if low in ends or (low == name and name in named) or (name == "cpp" and low == "c++"):
            return name
    raise ValueError(f"unknown language: {text}")


def parse_type(text: str, language: str | None = None) -> str:
    """Display form of a content type; code takes the given language, else rust."""
    names = {"output": "command_output", "mcp": "mcp_schema"}
    low = names.get(text.lower(), text.lower())
    if low not in TYPES or low == "unknown":
        raise ValueError(f"unknown content type: {text}")
    return f"code:{parse_language(language) if language else 'rust'}" if low == "code" else low


def service_type(text: str | None) -> str:
    """The service's lenient form: what it does not know is unknown."""
    try:
        return parse_type(text or "")
    except ValueError:
        return "unknown"


def service_level(text: str | None) -> str:
    return LEVEL_ALIASES.get((text or "").lower(), MEDIUM)
