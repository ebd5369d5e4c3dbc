"""License scans: fuzzy short-notice search.

A text is read as its words (runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, A-Z lower-cased) with single
blanks between, so punctuation and line breaks don't matter. A notice that may differ by e edits is
cut into e + 1 pieces: an occurrence with e edits at most holds one piece unchanged (pigeonhole).
Exact search for the pieces places candidates; round each one the regex library's bounded-error
match verifies a window and reports the span and the edits.

Base phrases are notices that must stand word for word: their places are found by the same pieces and
then verified without errors, on word bounds.

Defined results: null and empty texts have no words, no places and score 0; very long texts are
searched as a whole; repeated documents give a row each; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.llm import _text as T


@dataclass(frozen=True)
class Notice:
    """A phrase of words with its label, and the edits (of characters) that an occurrence may have."""

    phrase: str
    label: str
    edits: int


#: Phrases and labels of the contract.
BASE = (Notice("cc by", "cc-by", 0), Notice("general public license", "gpl", 0), Notice("all rights reserved", "reserved", 0))
#: Notices of the method's own, as licences word them.
NOTICES = (
    Notice("licensed under the apache license version 2 0", "apache-2.0", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("released under the mit license", "mit", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("licensed under cc by", "cc-by", 1),
    Notice("licensed under cc by sa", "cc-by-sa", 1),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("licensed under cc by nd", "cc-by-nd", 1),
    Notice("cc0 1 0 universal", "cc0", 1),
    Notice("all rights reserved", "reserved", 2),
    Notice("this work is in the public domain", "public-domain", 3),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("gnu free documentation license", "gfdl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("common development and distribution license", "cddl", 3),
    Notice("boost software license", "bsl", 2),
    Notice("sil open font license", "ofl", 2),
    Notice("the software is provided as is without warranty of any kind", "mit", 4),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    Notice("redistributions of source code must retain the above copyright notice", "bsd", 5),
    Notice("this software is provided as is without any express or implied warranty", "zlib", 4),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 4),
)


def pieces(phrase: str, edits: int) -> list[tuple[int, bytes]]:
    """The phrase in edits + 1 pieces of nearly equal length, each with its place."""
    raw, n = phrase.encode(), edits + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds notices in a step of texts."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: tuple[Notice, ...] = BASE):
        self.base, self.notices = base, notices
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for i, x in enumerate((*base, *notices)):
            for at, piece in pieces(x.phrase, x.edits):
                self.seeds.setdefault(piece, []).append((i, at))
        self.patterns = [regex.compile(rb"(?<![^ \n])(?=[^ \n])(?:%s){e<=%d}(?<=[^ \n])(?![^ \n])" % (regex.escape(x.phrase.encode(), literal_spaces=True), x.edits), regex.BESTMATCH) for x in notices]

    def canonical(self, data: np.ndarray, w: T.Words) -> tuple[bytes, np.ndarray]:
        """All words with single blanks between and two newlines between rows; where each word begins in it."""
        size = w.ends - w.starts
        gap = np.ones(len(size), np.int64)
        last = w.first[1:][np.diff(w.first) > 0] - 1
        gap[last] = 2
        at = np.concatenate([[0], np.cumsum(size + gap)])
        out = np.full(at[-1], 32, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, w.starts, 1)
        np.add.at(inside, w.ends, -1)
        mask = np.ones(at[-1], bool)
        mask[at[1:] - 1] = False
        double = at[last + 1] - 2
        mask[double] = False
        out[at[last + 1] - 1] = 10
        out[double] = 10
        out[mask] = T.LOWER[data[np.cumsum(inside[:-1]) > 0]]
        return out.tobytes(), at[:-1]

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, list[tuple[int, int, int, int]], list[tuple[int, int, int, int, int]]]:
        """The words; (row, first word, last word, base) of base places; (row, first, last, notice, edits) of fuzzy ones."""
        w = T.split_words(data, offsets, T.ALNUM_ANY, hashed=False)
        if not len(w.starts):
            return w, [], []
        text, at = self.canonical(data, w)
        hits: list[set[int]] = [set() for _ in range(len(self.base) + len(self.notices))]
        for piece, owners in self.seeds.items():
            p = text.find(piece)
            while p >= 0:
                for i, off in owners:
                    hits[i].add(p - off)
                p = text.find(piece, p + 1)
        sure, fuzzy = [], []
        word = lambda p: int(np.searchsorted(at, p, "right")) - 1
        row = lambda x: int(np.searchsorted(w.first, x, "right")) - 1
        for i, x in enumerate(self.base):
            raw = x.phrase.encode()
            for p in sorted(hits[i]):
                end = p + len(raw)
                if p >= 0 and text.startswith(raw, p) and (p == 0 or text[p - 1] in b" \n") and text[end] in b" \n":
                    a = word(p)
                    sure.append((row(a), a, a + raw.count(b" "), i))
        for i, x in enumerate(self.notices):
            size, done = len(x.phrase.encode()), -1
            for p in sorted(hits[len(self.base) + i]):
                lo, hi = max(0, p - x.edits - 1, done), p + size + x.edits + 1
                if hi - lo < size - x.edits:  # inside a span that is reported already
                    continue
                # a window stays in its row
                r = row(word(min(max(p + size // 2, 0), len(text) - 1)))
                lo = max(lo, int(at[w.first[r]]))
                hi = min(hi, int(at[w.first[r + 1]]) - 2 if w.first[r + 1] < len(at) else len(text) - 2)
                # and ends on word bounds, so that a match does
                lo, z = int(at[word(lo)]), word(hi - 1)
                hi = int(at[z] + w.ends[z] - w.starts[z])
                m = self.patterns[i].search(text, lo, hi)
                if m:
                    a, b = word(m.start()), word(m.end() - 1)
                    fuzzy.append((r, a, b, i, sum(m.fuzzy_counts)))
                    done = m.end() + 1
        return w, sure, fuzzy


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES, base: tuple[Notice, ...] = BASE) -> DataFrame:
    """One row per document: doc_id, n_words, and spans (label, first_word, last_word, edits, base) in text order."""
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("length", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base)
        for batch in batches:
            for i, j, data, offsets in T.text_steps(batch.column(1)):
                w, sure, fuzzy = scanner.places(data, offsets)
                out: list[list[dict]] = [[] for _ in range(j - i)]
                for r, a, b, x in sure:
                    out[r].append({"label": base[x].label, "first_word": a - w.first[r], "last_word": b - w.first[r], "edits": 0, "length": len(base[x].phrase), "base": True})
                for r, a, b, x, e in fuzzy:
                    out[r].append({"label": notices[x].label, "first_word": a - w.first[r], "last_word": b - w.first[r], "edits": e, "length": len(notices[x].phrase), "base": False})
                for own in out:
                    own.sort(key=lambda s: (s["first_word"], s["last_word"], not s["base"], s["label"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(w.first)), pa.array(out, pa.list_(span))], ["doc_id", "n_words", "spans"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return T.mapped(slim, run, f"doc_id {kind}, n_words long, spans array<struct<label:string,first_word:long,last_word:long,edits:int,length:int,base:boolean>>")


def license_report(docs: DataFrame, **options) -> DataFrame:
    """The spans' digest: places of base phrases, labels, and a score that is 1 for a word-for-word notice."""
    base = F.filter("spans", lambda s: s["base"])
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.greatest(s["length"], F.lit(1))))
    return license_spans(docs, **options).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"]))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        "spans",
    )
