"""Codes, labels, thresholds and placeholders that results are stated in."""

from __future__ import annotations

# category codes and their labels, in the order in which they are reported
CF, SELECTORS, FILLERS, ANSI = "cf-format", "variation-selectors", "blank-fillers", "ansi"
SURROGATES, COMMENTS, HIDDEN, EXFIL = "lone-surrogates", "html-comments", "hidden-html", "exfil-urls"
LABELS = {
    CF: "Format chars (Cf)",
    SELECTORS: "Variation selectors",
    FILLERS: "Blank-rendering fillers",
    ANSI: "ANSI escapes",
    SURROGATES: "Lone UTF-16 surrogates",
    COMMENTS: "HTML comments",
    HIDDEN: "hidden HTML",
    EXFIL: "exfil URLs",
}

LONG_RUN, SCATTERED = 10, 30
CLUSTER_CAP, BUDGET_FLOOR, VISIBLE_PER_JOINER = 8, 16, 8

NEAR_ZERO = 0.01
OFFSCREEN_ABSOLUTE, OFFSCREEN_VIEWPORT = -900, -100
SOURCE_LINES, SOURCE_SHARE = 5, 0.3

LONG_QUERY, LONG_DATA_URI, LONG_SEGMENT = 200, 4096, 128

MAX_DEPTH, MAX_FOLDS = 200, 8
MIN_ENV_SECRET, PREVIEW = 16, 88
MAX_REQUEST_BYTES = 10 * 1024 * 1024

COMMENT_MARK = "[HTML comment removed]"
HIDDEN_MARK = "[hidden HTML removed]"
UNPARSEABLE_MARK = "[HTML unparseable — withheld]"
HEX_DUMP_NOTE = " — inspect the removed bytes with a hex dump (xxd / od -c), which survives sanitization"
LONG_RUN_NOTE = " [LONG RUN — possible injection payload]"
SURROGATE_NOTE = "Normalized lone UTF-16 surrogates"
HINT = "[REDACTED"
