"""Hidden payloads in instruction files: found, decoded, cleaned."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import charset, plain
from ..functions.rows import arrow
from .layer1 import payload_count

FINDINGS = "array<struct<line:int,charCount:int,method:string,decoded:string>>"
_BITS = {0x200B: "0", 0x200C: "1", 0x200D: "|"}


def _and_more(n: int, what: str) -> str:
    return f" + {n} {what}" if n else ""


def decode_run(run: str) -> tuple[str, str]:
    """(method, decoded) of a run of invisible characters."""
    points = [ord(ch) for ch in run]
    tags = "".join(chr(p - 0xE0000) for p in points if 0xE0001 <= p <= 0xE007F)
    bits = "".join(_BITS[p] for p in points if p in _BITS)
    if 2 * len(tags) > len(points):
        return "Unicode tag characters → ASCII", tags + _and_more(len(bits), "zero-width char(s)")
    if 2 * len(bits) > len(points):
        return "zero-width binary encoding", f"[{len(bits)} zero-width chars: {bits[:80]}]" + _and_more(len(points) - len(bits), "other char(s)")
    return "invisible Unicode sequence", " ".join(f"U+{p:04X}" for p in points)


def scan_plain(content: str) -> list[dict]:
    out = []
    for start, run in plain.long_runs(content):
        method, decoded = decode_run(run)
        out.append({"line": content.count("\n", 0, start) + 1, "charCount": len(run), "method": method, "decoded": decoded})
    rest = plain.payload_count(content) - sum(f["charCount"] for f in out)
    if rest >= K.SCATTERED:
        out.append({"line": 0, "charCount": rest, "method": "scattered invisible chars (possible threshold evasion)", "decoded": f"[{rest} invisible chars distributed across file]"})
    return out


@arrow(FINDINGS)
def _scan(content: pd.Series) -> pd.Series:
    return content.map(lambda t: None if t is None else scan_plain(t))


def suspicious(content: Column) -> Column:
    """Texts with enough invisible characters for a finding; no others have one."""
    return (F.octet_length(content) > F.char_length(content)) & (F.regexp_count(content, F.lit(charset.quick(charset.java_invisible()))) >= K.LONG_RUN)


def scan_text(content: Column) -> Column:
    """Findings of a text; those without enough invisible characters never leave Spark."""
    return F.when(content.isNotNull(), F.coalesce(_scan(F.when(suspicious(content), content)), F.array().cast(FINDINGS)))


def scattered_count(content: Column) -> Column:
    """Payload characters outside long runs."""
    runs = F.regexp_extract_all(content, F.lit(f"({charset.quick(charset.java_invisible())}{{{K.LONG_RUN},}})"), 1)
    return payload_count(content) - F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r))


def _contained(path: Path, root: Path, pattern: str) -> bool:
    try:
        real = path.resolve(strict=True)
    except OSError:
        return False
    if real == root or root in real.parents:
        return True
    raise ValueError(f"instruction-file path escapes scan root: pattern {pattern!r} matched {str(path)!r} which resolves to {str(real)!r} outside {str(root)!r}")


def find_files(globs: Iterable[str], cwd: str = ".") -> list[str]:
    """Files that the globs match below ``cwd``, each once; node_modules is passed over."""
    root, out = Path(cwd).resolve(), {}
    for pattern in globs:
        base = Path("/") if os.path.isabs(pattern) else Path(cwd)
        for path in sorted(base.glob(pattern.lstrip("/") if os.path.isabs(pattern) else pattern)):
            if "node_modules" not in path.parts and _contained(path, root, pattern):
                out[str(path)] = None
    return list(out)


def scan_files(spark: SparkSession, globs: Iterable[str], cwd: str = ".") -> DataFrame:
    """file, findings of the local instruction files that have any."""
    files = [f for f in find_files(globs, cwd) if os.path.isfile(f)]
    if not files:
        return spark.createDataFrame([], f"file string, findings {FINDINGS}")
    return scan_table(spark.read.format("binaryFile").load([f"file://{os.path.abspath(f)}" for f in files]), cwd)


def scan_table(files: DataFrame, cwd: str | None = None) -> DataFrame:
    """The same over a table of files (path, content binary), from any store."""
    text = F.make_valid_utf8(F.col("content").cast("string"))  # malformed bytes become U+FFFD
    out = files.select("path", scan_text(text).alias("findings")).where(F.size("findings") > 0)
    root = "" if cwd is None else f"{os.path.abspath(cwd)}/"
    return out.select(F.regexp_replace(F.regexp_replace("path", r"\Afile:/+", "/"), "\\A\\Q" + root.replace("\\E", "\\E\\\\E\\Q") + "\\E", "").alias("file"), "findings")


def clean_text(content: Column) -> Column:
    """struct(cleaned, changed): stripped only where a finding is."""

    found = F.size(scan_text(content)) > 0
    stripped = F.coalesce(_strip(F.when(suspicious(content), content)), content)
    return F.struct(F.when(found, stripped).otherwise(content).alias("cleaned"), F.coalesce(found, F.lit(False)).alias("changed"))


@arrow("string")
def _strip(content: pd.Series) -> pd.Series:
    return content.map(lambda t: None if t is None else plain.drop_invisible(t)[0])


def clean_file(path: str) -> bool:
    """Cleans one local file in place, atomically, if it has findings; links are refused."""
    if os.path.islink(path):
        raise ValueError(f"refusing to clean through a symlink (instruction files must be regular files): {path!r}")
    mode = os.stat(path).st_mode
    with open(path, encoding="utf-8", newline="") as f:
        content = f.read()
    if not scan_plain(content):
        return False
    handle, name = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=os.path.dirname(os.path.abspath(path)))
    with open(handle, "w", encoding="utf-8", newline="") as f:
        f.write(plain.drop_invisible(content)[0])
    os.chmod(name, mode & 0o7777)
    os.replace(name, path)
    return True
