"""Column expressions over one text or one id array; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The special tokens, in id order 0..3.
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
PAD, UNK, BOS, EOS = range(4)
BYTE_VOCAB = 4 + 256

# Unicode white space; the four separators U+001C..U+001F are not in Java's \s.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# Word runs and punctuation runs; white space separates.
PRETOKEN = r"(?U)(\w+|[^\w\s]+)"
# The same, with literal special tokens cut out first.
_SPECIAL = "(?:" + "|".join(map(re.escape, SPECIALS)) + ")"
PRETOKEN_SPECIALS = rf"(?U)({_SPECIAL}|\w+|(?:(?!{_SPECIAL})[^\w\s])+)"
# The same as PRETOKEN, each white space character kept as a unit of its own.
PRETOKEN_RAW = r"(?U)(\s|\w+|[^\w\s]+)"


def whitespace_tokens(text: Column) -> Column:
    """Non-empty runs between Unicode white space."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def pretokens(text: Column, pattern: str = PRETOKEN) -> Column:
    """Runs of word characters and runs of other visible characters, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def one_line(text: Column) -> Column:
    """Newlines replaced by spaces, so that one text is one line."""
    return F.translate(text, "\n", " ")


def int_array(*values: int) -> Column:
    """An array<int> literal, also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def with_specials(ids: Column) -> Column:
    """Begin and end ids around an id array."""
    return F.concat(int_array(BOS), ids, int_array(EOS))


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes shifted by the number of special tokens.

    Reading the bytes as Latin-1 gives one character per byte, so the split is linear.
    """
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    codes = F.transform(chars, lambda c: F.ascii(c) + 4)
    return F.when(text == "", int_array()).otherwise(codes)


def bytes_to_text(ids: Column) -> Column:
    """Inverse of :func:`byte_ids`: specials skipped, invalid UTF-8 dropped."""
    top = F.coalesce(F.array_max(ids), F.lit(0))
    checked = F.when(top >= BYTE_VOCAB,
                     F.raise_error(F.concat(F.lit("byte id out of range: "), top))
                     ).otherwise(ids)
    chars = F.transform(F.filter(checked, lambda i: i >= 4), lambda i: F.char(i - 4))
    raw = F.encode(F.concat_ws("", chars), "ISO-8859-1").cast("string")
    return drop_invalid_utf8(raw)


def drop_invalid_utf8(raw: Column) -> Column:
    """Remove malformed sequences, keeping genuine U+FFFD characters.

    Spark can only replace malformed input by U+FFFD; genuine ones are escaped before
    and restored after.
    """
    escaped = F.replace(F.replace(raw, F.lit("\u0001"), F.lit("\u0001a")),
                        F.lit("\ufffd"), F.lit("\u0001b"))
    clean = F.replace(F.make_valid_utf8(escaped), F.lit("\ufffd"), F.lit(""))
    restored = F.replace(F.replace(clean, F.lit("\u0001b"), F.lit("\ufffd")),
                         F.lit("\u0001a"), F.lit("\u0001"))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def strip_specials(text: Column) -> Column:
    """Each special token's text removed in turn, the rest trimmed after each.

    Decoded tokens hold no white space of their own, so only spaces can be at the ends.
    """
    for token in SPECIALS:
        text = F.trim(F.replace(text, F.lit(token), F.lit("")))
    return text


def neighbours(items: Column) -> Column:
    """Adjacent element pairs ``struct(prev, cur)`` of an array."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(F.slice(items, F.lit(1), n).alias("prev"),
                        F.slice(items, F.lit(2), n).alias("cur"))
