"""Java regex forms of the escape grammar that neither recurse nor backtrack.

Java matches a repeated group by recursion and overflows its stack on long input, so
repetitions are possessive, and the digit that may end a sequence is spelled out.
"""

INTRODUCERS = r"[\x1b\x{9b}\x{9d}]"
STRAY = r"[\x1b\x{80}-\x{9f}]"
_STRING = r"(?:\x1b\]|\x{9d})(?:[^\x07\x1b\x{9c}\x{9d}]*(?:\x1b\\|\x{9c}|\x07)|[\s\S]*\z)"
_SEQUENCE = r"[\x1b\x{9b}][\[()#;?]{0,12}+(?:(?:\d{1,4}+(?:;\d{0,4}+)*+)?+[\dA-PR-TZcf-ntqry=><~]|\d{1,4}+(?:;++\d{1,4}+)*+)"
ESCAPES = f"(?:{_STRING}|{_SEQUENCE})"
COLOUR = r"(?:\x1b\[|\x{9b})[0-9;]*m"
TAG_PRESENT = r"<[a-zA-Z/!?][^<>]*>"
LINK_HINT = r"(?m)\]\(|!\[|^[ \t]*\[[^\[\]\n]+\]:[\s\x{A0}\x{FEFF}\x{2028}\x{2029}]"
SOURCE_TAG = r"</?[a-zA-Z][^<>]*>"
