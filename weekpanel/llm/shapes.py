"""Counts over the words of byte spans, shared by the quality operators."""

from __future__ import annotations

import numpy as np

from weekpanel.llm.base import Run, hash_words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
#: ASCII letters and every byte of other letters.
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
SENTENCE = np.zeros(256, bool)
SENTENCE[list(b".?!")] = True
CLOSING = LETTER | DIGIT
CLOSING[list(b".,;:?!'\")-")] = True
#: Letters, capitals and digits to one byte each; other bytes stay.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[LETTER], CLASS[UPPER], CLASS[DIGIT] = ord("a"), ord("A"), ord("0")

COUNTS = ("words", "chars", "symbols", "upper", "letters", "exclaim", "stutter", "bare", "closed", "sentence", "digits")


def span_sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of true flags between neighbouring edges."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return np.diff(total[edges])


def stutters(run: Run, hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Words equal to the one before in the same span; ``edges`` are word numbers."""
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    same[edges[:-1][edges[:-1] < len(same)]] = False
    return same


def counts(run: Run, hashes: np.ndarray, words: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One row of COUNTS for every span; ``words`` and ``edges`` are the spans' first words and bytes."""
    buf = run.buf
    named = span_sums(LETTER[buf] | DIGIT[buf], np.stack([run.starts, run.ends], 1).ravel())[::2] if len(run.starts) else np.zeros(0)
    last = buf[run.ends - 1] if len(run.ends) else np.zeros(0, np.uint8)
    by_byte = lambda flags: span_sums(flags[buf], edges)
    return np.stack([
        np.diff(words), np.diff(edges), by_byte(SYMBOL), by_byte(UPPER), by_byte(LETTER),
        span_sums(buf == 0x21, edges), span_sums(stutters(run, hashes, words), words), span_sums(named == 0, words),
        span_sums(CLOSING[last], words), span_sums(SENTENCE[last], words), by_byte(DIGIT)], 1).astype(np.float64)


def shape_hashes(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the classes of each word's first two and last three bytes."""
    classes = CLASS[run.buf]
    return (hash_words(classes, run.starts, np.minimum(run.ends, run.starts + 2)),
            hash_words(classes, np.maximum(run.starts, run.ends - 3), run.ends))
