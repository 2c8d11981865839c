"""Text classes shared by cleaning and chat parsing.

Python's ``\\w`` and ``\\s`` are Unicode-aware; the JVM and RE2 defaults are
ASCII.  The classes are therefore written out explicitly."""

# Python's whitespace set, and its word class as Unicode
# categories (letters, numbers, underscore).
WS_CLASS = (r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WORD_CLASS = r"\p{L}\p{N}_"
NON_WORD_NON_SPACE = f"[^{WORD_CLASS}{WS_CLASS}]+"
WS_RUN = f"[{WS_CLASS}]+"

# A plain decimal or scientific number, surrounding spaces allowed.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
