"""Column functions on text and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to loader family; everything else is unsupported.
FAMILIES = {
    ".pdf": "pdf", ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image", ".webp": "image", ".bmp": "image",
    ".txt": "text", ".md": "text", ".markdown": "text", ".docx": "document", ".odt": "document", ".html": "document", ".htm": "document",
}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_space(text: Column | str) -> Column:
    """Runs of Unicode white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(_column(text), r"(?U)\s+", " "))


def split_sentences(text: Column | str) -> Column:
    """Cut after ``.``, ``!`` or ``?`` and white space; the mark stays on the left. Empty text is one empty sentence."""
    return F.split(_column(text), r"(?<=[.!?])\s+")


def sentence_tokens(text: Column | str) -> Column:
    """The sentences without blanks at their ends, empty ones left out."""
    return F.filter(F.transform(split_sentences(text), lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_column(text), F.lit(r"(?U)\S+"))


def preview(text: Column | str, size: int = 200) -> Column:
    """The first ``size`` code points, with dots where more follow."""
    text = _column(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def safe_filename(name: Column | str) -> Column:
    """Base name with only word characters, blanks (as underscores), hyphens and single dots; empty if nothing is left."""
    base = F.regexp_replace(_column(name), r"^.*/", "")
    kept = F.regexp_replace(base, r"(?U)[^\w\s\-.]", "")
    dotted = F.regexp_replace(F.replace(kept, F.lit(" "), F.lit("_")), r"\.+", ".")
    return F.regexp_replace(dotted, r"^[. ]+|[. ]+$", "")


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty where the base name has none or only a leading dot."""
    base = F.regexp_replace(_column(path), r"^.*/", "")
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(name: Column | str) -> Column:
    """The name without its extension."""
    name = _column(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def family(ext: Column | str) -> Column:
    """Loader family of an extension; null where it is unsupported."""
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.try_element_at(known, _column(ext))


def content_hash(content: Column | str, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of bytes or UTF-8 text."""
    return F.substring(F.sha2(_column(content).cast("binary"), 256), 1, digits)


def unique_name(name: Column | str, path: Column | str, digest: Column | str) -> Column:
    """A name for an upload that depends on where it came from and what it holds, so a repeat gets the same."""
    name = _column(name)
    tag = F.substring(F.sha2(F.concat(_column(path), _column(digest)).cast("binary"), 256), 1, 8)
    return F.concat(stem(name), F.lit("_"), tag, extension(name))


def vector_text(vector: Column | str) -> Column:
    """A vector as ``[a,b,c]``."""
    return F.concat(F.lit("["), F.array_join(_column(vector).cast("array<string>"), ","), F.lit("]"))


def vector_from_text(text: Column | str, dim: int | None = None) -> Column:
    """The vector of ``[a,b,c]``; null where the text is no vector or not of ``dim`` numbers."""
    vector = F.from_json(_column(text), "array<float>")
    return vector if dim is None else F.when(F.size(vector) == dim, vector)
