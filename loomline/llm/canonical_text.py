"""Visually identical text with different characters, brought to one form.

Method: normalisation quick checks. A regular expression built from the characters' own properties finds the
segments that may change: runs of unstable characters together with the character before them, which a mark may
compose with. Unstable are characters whose quick check is No (they are not their own form) or Maybe (the second
characters of all primary composites, whatever their combining class), and all combining marks. Only these segments
are normalised; the rest of the text is spliced in unchanged.

The canonical form is NFC text without characters that show nothing, with plain spaces and hyphens, with
letters and digits of ordinary width, without joined letters, and with one letter for those that have the same
shape (SAME_SHAPE, or a table in the format of the public confusables list, see `read_shapes`). Case, accents, raised digits, punctuation and wording stay.
Line ends CR LF become LF. A null text stays null; an empty text equals one of invisible characters only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import meet
from .storage import checkpointed

# Letters of the same shape, listed pairwise: Cyrillic, Greek, Armenian and Cherokee letters and their Latin ones.
SAME_SHAPE = str.maketrans(
    "аеорсухѕіјһԁԛԝѵӏАВЕКМНОРСТУХЅІЈԚԜӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνօսհᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ",
    "aeopcyxsijhdqwvlABEKMHOPCTYXSIJQWIABEZHIKMNOPTYXocjvouhABCDEGHJKLMPRSTVWZ",
)
# Kinds of a single space and of a hyphen.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
# Characters outside the format and control categories that show nothing.
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
_PLAIN = str.maketrans(SPACES + HYPHENS, " " * len(SPACES) + "-" * len(HYPHENS))


def read_shapes(path: str) -> dict[int, str]:
    """A table of same-shape letters from a file in the format of the public confusables list: "source ; target ; type # note", in hex.

    Only single letters that stand for a single letter of the same case are taken; digits, punctuation and sequences are left out, as
    they make a visible difference here.
    """
    table: dict[int, str] = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            parts = line.split("#", 1)[0].split(";")
            if len(parts) < 2:
                continue
            source, target = ("".join(chr(int(x, 16)) for x in part.split()) for part in parts[:2])
            if len(source) == len(target) == 1 and source.isalpha() and target.isalpha() and source.isupper() == target.isupper():
                table[ord(source)] = target
    return table


def shows_nothing(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind == "Cf" or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85") or c in BLANKS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF


def _simple(c: str) -> str:
    """A character by itself: ordinary width, joined letters apart."""
    form = unicodedata.decomposition(c)
    if form[:6] in ("<wide>", "<narro") and unicodedata.category(c)[0] in "LN":
        return unicodedata.normalize("NFKC", c)
    if form.startswith("<compat>") and unicodedata.category(c)[0] == "L" and len(form.split()) > 2 and unicodedata.name(c, "").startswith(("LATIN", "ARMENIAN")):
        parts = unicodedata.normalize("NFKC", c)
        return parts if parts.isalpha() else c
    return c


def canonical_segment(segment: str, shapes: dict[int, str] = SAME_SHAPE) -> str:
    text = "".join(_simple(c) for c in segment.replace("\r\n", "\n") if not shows_nothing(c)).translate(_PLAIN)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(shapes))


def _points() -> list[int]:
    """Code points from 0x80 on but the large blocks of ideographs and Hangul syllables, which are stable, and unassigned or private planes."""
    spans = ((0x80, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
    return [p for a, b in spans for p in range(a, b)]


def quick_check_maybe() -> set[str]:
    """The second characters of primary composites, which may compose with a character before them."""
    found: set[str] = set()
    for p in _points():
        c = chr(p)
        form = unicodedata.decomposition(c)
        if form and form[0] != "<" and " " in form and unicodedata.is_normalized("NFC", c):
            found.add(chr(int(form.split()[1], 16)))
    return found


def _unstable(shapes: dict[int, str]) -> str:
    """A character class of all characters that are unstable alone or may change with the one before them."""
    maybe = quick_check_maybe()
    bad = [p for p in range(0x80) if shows_nothing(chr(p)) or canonical_segment(chr(p), shapes) != chr(p)] + [0x0D]
    for p in _points():
        c = chr(p)
        if unicodedata.category(c) == "Cn":
            continue
        if unicodedata.combining(c) or c in maybe or canonical_segment(c, shapes) != c or 0x1160 <= p <= 0x11FF:
            bad.append(p)
    bad = sorted(set(bad))
    spans: list[list[int]] = []
    for p in bad:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans)


class Canonical:
    """Text -> canonical text; remembers segments, which recur."""

    MOST = 200_000

    def __init__(self, shapes: dict[int, str] = SAME_SHAPE) -> None:
        self.shapes = shapes
        unstable = _unstable(shapes)
        self.segment = re.compile(f"[^{unstable}]?[{unstable}]+", re.S)
        self.ascii_clean = re.compile("[\x00-\x08\x0e-\x1f\x7f\r]")
        self.known: dict[str, str] = {}

    def _form(self, match: re.Match) -> str:
        segment = match.group()
        form = self.known.get(segment)
        if form is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            form = canonical_segment(segment, self.shapes)
            if segment.endswith("\r"):  # a lone line end; CR LF is put together below
                form = canonical_segment(segment[:-1], self.shapes) + "\r"
            self.known[segment] = form
        return form

    def __call__(self, text: str) -> str:
        if "\r\n" in text:
            text = text.replace("\r\n", "\n")
        if text.isascii() and not self.ascii_clean.search(text):
            return text
        return self.segment.sub(self._form, text)

    def changed(self, text: str) -> int:
        """Number of segments that differ from their canonical form."""
        return text.count("\r\n") + sum(self._form(m) != m.group() for m in self.segment.finditer(text.replace("\r\n", "\n")))


_MADE: dict[str | None, Canonical] = {}


def canonical(shapes_path: str | None = None) -> Canonical:
    """The worker's own instance; its table takes a second or two to build. shapes_path: see `read_shapes`; SAME_SHAPE without."""
    if shapes_path not in _MADE:
        _MADE[shapes_path] = Canonical(SAME_SHAPE if shapes_path is None else read_shapes(shapes_path))
    return _MADE[shapes_path]


def canonical_documents(documents: DataFrame, shapes_path: str | None = None) -> DataFrame:
    """(doc_id, canonical, segments): the canonical text and the number of segments that changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = canonical(shapes_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [None if t is None else form(t) for t in texts]
            n = [None if t is None else 0 if t == c else form.changed(t) for t, c in zip(texts, out)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "canonical", "segments"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, canonical string, segments int")


def text_digests(documents: DataFrame, shapes_path: str | None = None) -> DataFrame:
    """(doc_id, raw, form): 128-bit digests of the text and of its canonical form; texts stay in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, digest = canonical(shapes_path), xxhash.xxh3_128_digest
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [(i, digest(t.encode("utf-8", "surrogatepass")), digest(form(t).encode("utf-8", "surrogatepass"))) for i, t in zip(ids, texts) if t is not None and i is not None]
            if rows:
                i, r, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(r, pa.binary()), pa.array(f, pa.binary())], names=["doc_id", "raw", "form"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, raw binary, form binary")


def look_alike_rows(documents: DataFrame, shapes_path: str | None = None) -> DataFrame:
    """(doc_id, raw, form) of the documents whose canonical form another string has too.

    Forms with a single string, however many rows have it, are dropped by a partial aggregate before any row is joined.
    """
    rows = checkpointed(text_digests(documents, shapes_path))
    several = rows.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x <> y").select("form")
    return checkpointed(rows.join(several, "form", "left_semi"))


def look_alike_classes(documents: DataFrame, shapes_path: str | None = None) -> DataFrame:
    """(doc_id, class_id, strings, links): each document that looks like another of a different string.

    class_id is the class's smallest doc_id, strings the number of its different strings, links the number of rows with another string than
    the document's own. Its size is that of the documents, however large a class is.
    """
    rows = look_alike_rows(documents, shapes_path)
    per_string = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("same"), F.min("doc_id").alias("first"))
    per_form = per_string.groupBy("form").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("strings"), F.sum("same").alias("all"))
    return rows.join(per_string.select("raw", "same"), "raw").join(per_form, "form").select("doc_id", "class_id", "strings", (F.col("all") - F.col("same")).alias("links"))


def look_alike_pairs(documents: DataFrame, shapes_path: str | None = None) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) whose texts are different strings but have one canonical form.

    Copies of one string are no pair. Strings are paired first and their documents joined to the pairs, so copies of one string never meet.
    All pairs of a class are listed, its rows being spread over blocks (see `blocks`), so no task holds a class. Null texts and ids have
    no pair; an empty table gives none.
    """
    rows = look_alike_rows(documents, shapes_path)
    strings = checkpointed(rows.select("form", "raw").distinct())
    differing = meet(strings, strings.withColumnRenamed("raw", "other"), "form").where("raw < other").select("raw", "other")
    first = meet(differing, rows.select("raw", F.col("doc_id").alias("x")), "raw").select("other", "x")
    pairs = meet(first, rows.select(F.col("raw").alias("other"), F.col("doc_id").alias("y")), "other").where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
