"""Text rules of the continuity model as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that state texts are compared without; white space and line ends of the model's texts; phrases
#: that state texts are brought to one form of; what memory texts are compared without.
STATE_STOPWORDS = ("a", "an", "the", "is", "are", "still", "yet")
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space of the SQL beside the queries, and what its trim takes off: the spaces of Unicode.
SQL_SPACE = r"[\t\n\f\r ]"
SQL_TRIMMED = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
STILL_MISSING, NOT_YET = r"\b(?:is )?still missing\b", r"\bno\s+(.+?)\s+yet\b"
#: What lies between words, but for single spaces, which stay as they are.
NO_WORD = r"[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*| [^\p{L}\p{N}_]+"
VOLATILE_ID = r"\b(?:turn|session|project|observation)_?id\s*[:=]\s*[a-z0-9_.:-]+\b"
ISO_TIME = r"\b\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:z|[+-]\d{2}:\d{2})?\b"


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def sql_squash(text: Column) -> Column:
    """squash as the SQL beside the queries has it: other white space stays, but for spaces at the ends."""
    return F.trim(F.regexp_replace(text, f"{SQL_SPACE}+", " "), F.lit(SQL_TRIMMED))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO time, null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def normalize_state(text: Column) -> Column:
    """Case and spacing folded; "still missing" and "no X yet" brought to "X missing"; punctuation dropped."""
    low = F.lower(F.coalesce(text, F.lit("")))
    phrases = F.regexp_replace(F.regexp_replace(squash(low), STILL_MISSING, " missing"), NOT_YET, "$1 missing")
    # most texts have neither word; "no" alone would have each of its places search the whole rest of the text
    out = F.when(F.contains(low, F.lit("still")) | F.contains(low, F.lit("yet")), phrases).otherwise(low)
    return F.trim(F.regexp_replace(out, NO_WORD, " "))


def state_tokens(normalized: Column) -> Column:
    return F.array_except(F.array_remove(F.split(normalized, " "), ""), F.array(*map(F.lit, STATE_STOPWORDS)))


def state_matches(left: Column, right: Column) -> Column:
    """Equal, or contained with 18 characters at least, or one token set within the other (neither empty)."""
    a, b = state_tokens(left), state_tokens(right)
    within = (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    return (left == right) | ((F.length(left) >= 18) & F.contains(right, left)) | ((F.length(right) >= 18) & F.contains(left, right)) | within


def normalize_memory(text: Column) -> Column:
    """Case folded, slashes unified, volatile ids and ISO times dropped, spacing squashed."""
    out = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\\"), F.lit("/"))
    return squash(F.regexp_replace(F.regexp_replace(out, VOLATILE_ID, ""), ISO_TIME, ""))


def fingerprint(kind: Column, status: Column, text: Column) -> Column:
    return F.sha2(normalize_memory(F.concat_ws("\u0000", kind, status, text)), 256)


def compact(text: Column, limit: int) -> Column:
    one_line = squash(text)
    return F.when(F.length(one_line) > limit, F.concat(F.rtrim(F.substring(one_line, 1, limit - 1)), F.lit("…"))).otherwise(one_line)


def approx_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / 4)).cast("long")
