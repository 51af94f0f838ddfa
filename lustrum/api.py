"""One text at a time, without Spark: the same functions that the columns run."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from . import constants as K
from .functions import charset, plain, urls
from .functions.secrets import Config
from .operators import hidden, instructions, output
from .operators import prompt as prompt_operator


@dataclass(frozen=True)
class SanitizeResult:
    cleaned: str
    found: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class PromptVerdict:
    action: str
    reason: str | None = None


def sanitize(text: str, html: bool = False) -> SanitizeResult:
    """Layer 1, and with ``html`` layers 2 and 3; URLs are judged before anything is cut out."""
    one = plain.layer1(text)
    found = list(one.found)
    warnings = [plain.describe_stripped(found, one.de_ansi)] if found else []
    cleaned = plain.mend_surrogates(one.cleaned)
    if plain.has_lone_surrogate(one.cleaned):
        found.append(K.SURROGATES)
        warnings.append(K.SURROGATE_NOTE)
    shaped = urls.reasons(cleaned) if html else []
    if html and (got := hidden.sanitize(cleaned)):
        new, (comments, elements), (tags, data) = got
        if new != cleaned:
            found += [K.COMMENTS] * bool(comments) + [K.HIDDEN] * bool(elements)
            parts = [f"{n} {what}" for n, what in ((comments, "HTML comment(s)"), (elements, "hidden element(s)")) if n]
            warnings.append(f"HTML sanitized: {', '.join(parts)} replaced with placeholders")
        kept = [f"{tag}×{n}" for tag, n in tags.items()] + [f"data: URI×{data}"] * bool(data)
        if kept:
            warnings.append(f"Preserved but reported (page source kept inspectable): {', '.join(kept)}")
        cleaned = new
    if shaped:
        found.append(K.EXFIL)
        warnings.append(f"Exfil-shaped URLs detected: {'; '.join(shaped)}")
    return SanitizeResult(cleaned, found, warnings)


def sanitize_text(text: str, html: bool = False, exfil_scan: bool = False, config: Config | None = None) -> tuple[str, list[str], bool]:
    """(cleaned, warnings, modified); ``config`` is that of the redaction, if there is to be one."""
    return output.clean_plain(text, html, exfil_scan, config)


def classify_prompt(prompt: str) -> PromptVerdict:
    """pass, note (colours only) or block with a reason."""
    escapes = plain.INTRODUCER.search(prompt) is not None
    de_ansi = plain.drop_escapes(prompt)
    runs, count = plain.long_runs(de_ansi), plain.payload_count(de_ansi)
    quiet = not runs and count < K.SCATTERED
    if quiet and not escapes:
        return PromptVerdict("pass")
    if quiet and plain.colour_only(prompt):
        return PromptVerdict("note")
    codes = {charset.category(ch) for ch in de_ansi}
    labels = [K.LABELS[c] for c in (K.CF, K.SELECTORS, K.FILLERS) if c in codes] + [K.LABELS[K.ANSI]] * escapes
    parts = [f"Detected: {', '.join(labels)}.", f"Invisible char count: {count} (long-run threshold: {K.LONG_RUN}, scattered threshold: {K.SCATTERED})."]
    if runs:
        parts.append(f"Long-run sample (first 16 code points): {' '.join(f'U+{ord(ch):04X}' for ch in runs[0][1][:16])}.")
    return PromptVerdict("block", " ".join([*parts, prompt_operator.ADVICE]))


def scan_instruction_files(globs: list[str], cwd: str = ".") -> list[tuple[str, list[dict]]]:
    """(file, findings) of the local files that have any."""
    out = []
    for name in instructions.find_files(globs, cwd):
        try:
            with open(name, encoding="utf-8", errors="replace", newline="") as f:
                found = instructions.scan_plain(f.read())
        except OSError:
            continue
        if found:
            out.append((os.path.relpath(name, cwd), found))
    return out


def scan_instruction_text(content: str) -> list[dict]:
    return instructions.scan_plain(content)


def clean_file(path: str) -> bool:
    return instructions.clean_file(path)
