"""Quality rules, line first.

Every line is judged on its own by rules of punctuation, navigation and boilerplate; lines that
fail go, and a document whose lines lose more than ``max_lost`` of its word characters (code points
of words) is rejected; one that loses exactly so much stays.
The statistics of whole texts (words, symbols, repeated lines, repeated three-word windows) reject
documents that are too short or mostly repetition before that.

Defined results: a null or wordless text has no words and fails the base rule; an empty line passes
(it has nothing to lose); texts of any length are read whole; a null doc_id is carried along;
repeated rows are judged each; without documents there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The characters that n_symbols counts.
SYMBOLS = re.compile(rb"[#*$%&|<>]")

#: A line that ends in none of these and has fewer than MIN_WORDS words is a fragment.
TERMINAL = re.compile(rb"(?:[.!?:;,\"')\]]|\xe2\x80[\x99\x9d\xa6]|\xc2\xbb)[ \t\r\x0b\x0c]*\Z")
MIN_WORDS = 4

#: Separators of link lists; so many of them, and one to every three words, make a line navigation.
NAVIGATION = re.compile(rb"(?:\A|[ \t])(?:\||>|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2)(?=[ \t]|\Z)")
MIN_SEPARATORS = 3

#: Phrases of pages' frames, in lower case: English, French, German, Spanish.
BOILERPLATE = re.compile(
    "tous droits r\u00e9serv\u00e9s|politique de confidentialit\u00e9|mentions l\u00e9gales|conditions d'utilisation|accepter (?:tous )?les cookies|retour en haut|"
    "alle rechte vorbehalten|datenschutzerkl\u00e4rung|nutzungsbedingungen|cookies (?:akzeptieren|zulassen)|zum seitenanfang|newsletter abonnieren|"
    "todos los derechos reservados|pol\u00edtica de (?:privacidad|cookies)|aviso legal|condiciones de uso|aceptar (?:todas )?las cookies|volver arriba|".encode()
    + rb"all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|accept (?:all )?cookies|"
    rb"we use cookies|enable javascript|subscribe to our newsletter|sign up for our|click here to|"
    rb"skip to (?:main )?content|powered by|back to top|share this (?:page|article|post)|lorem ipsum|"
    rb"copyright (?:\(c\)|\xc2\xa9)|\xc2\xa9 ?\d{4}"
)
#: A line with more symbols than this share of its word characters is markup or noise.
MAX_SYMBOLS = 0.2


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def line_fault(line: bytes) -> str | None:
    """The first rule that a line fails."""
    words = line.split()
    if not words:
        return None
    if BOILERPLATE.search(line.lower() if line.isascii() else line.decode("utf-8", "replace").lower().encode()):
        return "boilerplate"
    separators = len(NAVIGATION.findall(line))
    if separators >= MIN_SEPARATORS and 3 * separators >= len(words) - separators:
        return "navigation"
    if len(SYMBOLS.findall(line)) > MAX_SYMBOLS * code_points(b"".join(words)):
        return "symbols"
    if len(words) < MIN_WORDS and not TERMINAL.search(line):
        return "punctuation"
    return None


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(common.WORD_SPACE):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    times, repeated, upto = Counter(windows), 0, 0
    if len(times) < len(windows):
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated += k + 3 - max(k, upto)
                upto = k + 3
    return len(words), code_points(b"".join(words)), len(SYMBOLS.findall(text)), dup, repeated


def clean_lines(text: bytes) -> tuple[bytes, float]:
    """The lines that pass every rule, and the share of word characters lost with the others."""
    kept, lost, total = [], 0, 0
    for line in text.split(b"\n"):
        n = code_points(b"".join(line.split()))
        total += n
        if line_fault(line) is None:
            kept.append(line)
        else:
            lost += n
    return b"\n".join(kept), lost / total if total else 0.0


_FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost double, clean_text string"


def judge(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The statistics, the verdicts, the share lost and the cleaned text of every row of docs."""
    long, text = pa.int64(), pa.string()
    schema = pa.schema([("doc_id", long), *((c, long) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost", pa.float64()), ("clean_text", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in common.texts(batch["text"]):
                stats = base(t)
                failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
                cleaned, lost = clean_lines(t)
                rows.append((*stats, failed, not failed and lost <= max_lost, lost, cleaned.decode("utf-8", "replace")))
            if rows:
                yield from common.batches(schema, [batch["doc_id"], *zip(*rows)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FIELDS)
