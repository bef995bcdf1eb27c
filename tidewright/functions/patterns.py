"""Word lists, patterns and constants whose results must be the same in any implementation."""

from __future__ import annotations

# Classes written out, so that Java and RE2 read them alike: word characters and white space of the Unicode standard.
W = r"\p{L}\p{N}_"
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INLINE = r"\t\x{0B}-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SENTINEL = r"\[\[\p{Nd}+\]\]"
NUMBER = rf"\p{{Nd}}[\p{{Nd}}{SPACE}.,]*\p{{Nd}}|\p{{Nd}}"
IDENTIFIER = rf"(?<![{W}])[A-Za-z][{W}.-]*\p{{Nd}}[{W}.-]*"
ESCAPE = r"\\[&%$#_{}~^]"
LETTERS = r"[A-Za-z']+"
SENTENCE_END = rf"[.!?](?:[{SPACE}]|$)"
CONTROL_LEAK = r"<\|[^|]*\|>"
CONTROL_TOKEN = r"<\|[^|>]{0,64}\|>"
CHATTER = r"(?i)\A\s*(here (is|are)\b|sure[,!]|certainly[,!]|of course[,!]|the translation\b|translation:|voici\b|bien s.r[,!]|i (have|'ve) translated\b|below is\b)"
COMMENT = r"(?<!\\)%[^\n]*"
DOCUMENT = r"\\begin\s*\{document\}"
INCLUDE = r"\\(?:input|include|subfile)\s*\{([^{}]*)\}"
HYPHENATED = rf"(?<![{W}])[A-Za-z][{W}]*(?:-[{W}]+)+(?![{W}])"
CAP_PHRASE = rf"(?<![{W}])[A-Z][a-z]+(?: [A-Z][a-z]+)+(?![{W}])"
COINED = rf"(?<![{W}])[A-Za-z]+(?:[A-Z]|[0-9])[{W}]*(?![{W}])"
WORD = r"[A-Za-z][A-Za-z']*"
CONTENT_WORD = r"[A-Za-z][A-Za-z'-]*"
MACRO = r"\\[A-Za-z@]+\*?"
ENVIRONMENT = r"\\(?:begin|end)\s*\{([^{}]*)\}"
KEYED = r"\\(label|ref|eqref|cite|citep|citet|citealp|autoref|cref|Cref)\s*\{([^{}]*)\}"
MATH = r"(?<!\\)\$[^$]*\$|\\\[[\s\S]*?\\\]"
FORMATS = {"markdown": (".md", ".markdown", ".mdown"), "latex": (".tex", ".latex")}

NEGATIONS = ["not", "no", "never", "none", "neither", "nor", "cannot", "without", "fails", "fail", "unable", "absent"]
HEDGES = [
    "may", "might", "could", "possibly", "perhaps", "arguably", "seems", "seem", "appears", "appear", "suggests", "suggest", "likely",
    "probably", "generally", "typically", "often", "somewhat", "relatively",
]
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "that", "this", "these", "those", "is", "are", "was", "were",
    "be", "been", "being", "as", "by", "at", "from", "it", "its", "we", "our", "which", "than", "then", "so", "such", "can", "may", "also",
    "has", "have", "had", "not", "do", "does", "did", "if", "when", "while", "each", "all", "both", "more",
]
ENDINGS = [
    ("isation", "ization"), ("isations", "izations"), ("ise", "ize"), ("ised", "ized"), ("ises", "izes"), ("ising", "izing"), ("yse", "yze"),
    ("ysed", "yzed"), ("yses", "yzes"), ("ysing", "yzing"), ("our", "or"), ("ours", "ors"), ("re", "er"), ("res", "ers"), ("ogue", "og"),
    ("ogues", "ogs"), ("ce", "se"), ("aeon", "eon"), ("oedema", "edema"),
]
LANGUAGES = {
    "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "ja": "Japanese", "zh": "Chinese",
    "ru": "Russian", "ko": "Korean", "ar": "Arabic", "hi": "Hindi", "en": "English",
}
PIVOT_SPACES = ["\u00a0", "\u202f", "\u2009", "\u2007"]
ECHOED = [(r"\A(?:[-*+]|\d{1,9}[.)])[ \t]+", "list marker"), (r"\A>[ \t]*", "blockquote marker"), (r"\A#{1,6}[ \t]+", "heading marker"), (r"\A\\item\b[ \t]*", "latex item")]
ASSET_SKIP_DIRS = [".git", ".svn", ".hg", ".venv", "venv", "__pycache__", "node_modules", "_minted", ".build"]
ASSET_SKIP_SUFFIXES = [".aux", ".log", ".out", ".toc", ".synctex", ".fls", ".fdb_latexmk", ".blg", ".bbl", ".pyc"]
ASSET_SKIP_SOURCES = [".tex", ".latex", ".md", ".markdown", ".mdown"]
MIN_WORDS = 7
OVERHEAD_SECONDS = 18.6
SECONDS_PER_CHAR = 0.0857
CACHED_BELOW_SECONDS = 1.0
MIN_OCCURRENCES, MAX_SURVIVAL = 3, 0.5
MAX_INCLUDE_DEPTH, MAX_INCLUDE_FILES = 32, 500
PERSONA_MAX_BYTES = 64 * 1024
SAFE_NAME = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"
