"""What a name is in each programming language, as patterns and word lists."""

from dataclasses import dataclass

# Reserved words per language.
PYTHON_WORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
    "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal",
    "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)
PHP_WORDS = (
    "abstract", "and", "array", "as", "break", "callable", "case", "catch", "class", "clone", "const", "continue",
    "declare", "default", "die", "do", "echo", "else", "elseif", "empty", "enddeclare", "endfor", "endforeach",
    "endif", "endswitch", "endwhile", "eval", "exit", "extends", "false", "final", "finally", "for", "foreach",
    "function", "global", "goto", "if", "implements", "include", "include_once", "instanceof", "insteadof",
    "interface", "isset", "list", "namespace", "new", "null", "or", "parent", "print", "private", "protected",
    "public", "require", "require_once", "return", "static", "self", "switch", "this", "true", "throw", "trait",
    "try", "unset", "use", "var", "while", "xor", "__CLASS__", "__DIR__", "__FILE__", "__FUNCTION__", "__LINE__",
    "__METHOD__", "__NAMESPACE__", "__TRAIT__",
)
JAVA_WORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue",
    "default", "do", "double", "else", "enum", "extends", "false", "final", "finally", "float", "for", "goto", "if",
    "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package", "private",
    "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "true", "try", "void", "volatile", "while",
)
GO_WORDS = (
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "false", "for", "func",
    "go", "goto", "if", "import", "interface", "iota", "map", "nil", "package", "range", "return", "select", "struct",
    "switch", "true", "type", "var",
)
RUBY_WORDS = (
    "BEGIN", "END", "__ENCODING__", "__FILE__", "__LINE__", "alias", "and", "begin", "break", "case", "class", "def",
    "do", "else", "elsif", "end", "ensure", "false", "for", "if", "in", "module", "next", "nil", "not", "or", "redo",
    "rescue", "retry", "return", "self", "super", "then", "true", "undef", "unless", "until", "when", "while",
    "yield",
)
JAVASCRIPT_WORDS = (
    "async", "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do",
    "else", "export", "extends", "false", "finally", "for", "function", "get", "if", "import", "in", "instanceof",
    "let", "new", "null", "of", "return", "set", "static", "super", "switch", "this", "throw", "true", "try",
    "typeof", "undefined", "var", "void", "while", "with", "yield",
)

# Possessive and lazy loops over classes only: they do not recurse, so texts of any length pass.
_HASH = r"#[^\n]*+"
_SLASHES = r"//[^\n]*+"
_BLOCK = r"/\*(?s:.*?)\*/"
_PREFIX = r"(?<![\p{L}\p{N}_])[fFrRbBuU]{0,2}"
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_BACKTICK = r"`[^`]*+`"
_TRIPLE = r'"""(?s:.*?)"""' + "|" + r"'''(?s:.*?)'''"
_NUMBER = r"(?<![\p{L}\p{N}_])[0-9][\p{L}\p{N}_.]*+"
_PHP_TAG = r"<\?php\b|<\?=?|\?>"


@dataclass(frozen=True)
class Language:
    reserved: tuple[str, ...]
    skipped: str  # comments and strings, in the order in which they are tried
    name: str = r"[\p{L}_][\p{L}\p{N}_]*"


LANGUAGES = {
    "python": Language(PYTHON_WORDS, "|".join([f"{_PREFIX}(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE})", _HASH, _NUMBER])),
    "php": Language(PHP_WORDS, "|".join([_BLOCK, _PHP_TAG, _DOUBLE, _SINGLE, _SLASHES, _HASH, _NUMBER])),
    "java": Language(JAVA_WORDS, "|".join([_BLOCK, _DOUBLE, _SINGLE, _SLASHES, _NUMBER])),
    "go": Language(GO_WORDS, "|".join([_BLOCK, _DOUBLE, _SINGLE, _BACKTICK, _SLASHES, _NUMBER])),
    "ruby": Language(RUBY_WORDS, "|".join([_DOUBLE, _SINGLE, _HASH, _NUMBER])),
    "javascript": Language(
        JAVASCRIPT_WORDS, "|".join([_BLOCK, _DOUBLE, _SINGLE, _BACKTICK, _SLASHES, _NUMBER]), r"[\p{L}_$][\p{L}\p{N}_$]*"
    ),
}
