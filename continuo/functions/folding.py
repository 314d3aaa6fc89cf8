"""Search text without case and accents, its tokens and tags, as column expressions and for driver-side queries."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from continuo.functions.text import squash


def _base(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def _single_letters() -> dict[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks that fold to one other letter, by the Unicode rule."""
    pairs = ((chr(c), _base(chr(c))) for block in (range(0xC0, 0x530), range(0x1E00, 0x2000)) for c in block)
    return {c: base for c, base in pairs if len(base) == 1 and base != c}


_LETTERS = _single_letters()


def fold_query(text: str | None) -> str:
    """The same folding for one text of the driver."""
    return " ".join(_base(text or "").replace("_", "-").split())


def query_tokens(text: str | None) -> set[str]:
    return set(re.findall("[a-z0-9]+", fold_query(text)))


def plain_query(text: str) -> str:
    return re.sub("[\u0300-\u036f]+", "", text.lower()).translate(str.maketrans(_LETTERS))


def plain(text: Column) -> Column:
    """Lower case without accents; null is the empty text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}+", "")
    return F.translate(out, "".join(_LETTERS), "".join(_LETTERS.values()))


def fold(text: Column) -> Column:
    """Lower case, accents dropped, underscores as hyphens, spacing squashed; null folds to the empty text."""
    return squash(F.translate(F.replace(plain(text), F.lit("ß"), F.lit("ss")), "_", "-"))


def tokens(text: Column) -> Column:
    """The distinct ASCII words of the folded text."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)))


def tag_key(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(tag), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def detail_tags(detail: Column) -> Column:
    """Tags of all ``Tags: a, b`` lines in order, each once."""
    lines = F.regexp_extract_all(F.coalesce(detail, F.lit("")), F.lit(r"(?im)^[^\S\r\n]*tags:([^\r\n]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.split(F.array_join(lines, ","), ","), squash), lambda t: t != ""))


def path_leaf(path: Column) -> Column:
    """Last part of a path of either slash, null if there is none."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(F.trim(path), "^[\"'`]+|[\"'`]+$", ""), "\\", "/"), "/+$", "")
    return F.nullif(F.substring_index(bare, "/", -1), F.lit(""))


def path_key(path: Column) -> Column:
    """One form of a root path: unified slashes, none at the end, case folded."""
    return F.lower(F.regexp_replace(F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/"), "/+$", ""))


def within(path: Column, root: Column) -> Column:
    """True if the path is the root or below it, or if either is missing."""
    p, r = path_key(path), path_key(root)
    return (p == "") | (r == "") | (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def slug(label: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 48), F.lit("")), F.lit("snapshot"))
