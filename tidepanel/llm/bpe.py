"""Byte-pair encoding and decoding of whole texts with a public vocabulary (operator 13).

A word's adjacent pairs are the leaves of a segment tree of (merge rank, place) with sixteen children a node; the root
is the leftmost pair of the lowest rank. A merge changes three leaves and the nodes above them, in logarithmic time,
until the root says that no pair can be merged.
So a word of a million letters takes n log n steps. Words repeat, and a bounded cache keeps the short ones' ids.

Documents are dealt by Spark as they are stored, without a shuffle; a task holds one text at a time besides its batch.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .alignment import byte_alphabet
from .common import fresh

#: Runs of words (and half the words) that a worker remembers, their longest length, and runs that are joined at once.
CACHE, SHORT, BLOCK = 1 << 18, 48, 1 << 16
#: Children of a node of the tree, and the key of a pair that can't be merged.
FAN, _NONE = 16, 1 << 62
#: White space as the pattern means it. Python's ``split`` also splits at four control characters.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_RUNS, _SEPARATORS = regex.compile(f"[^{WHITE}]+"), regex.compile(r"[\x1C-\x1F]")


class Bpe:
    """What the vocabulary file says: merges, pieces, words that stand for themselves, pattern of words.

    Files of this kind are read: NFC, white space to one space, lower case; words by a pattern, bytes as characters,
    merges with an end-of-word suffix, no decoder. Any other setting is refused.
    """

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, steps, cuts = spec["model"], spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        known = (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
            and model["type"] == "BPE" and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
            and spec["decoder"] is None and not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"])
        )
        if not known:
            raise ValueError("the vocabulary file asks for steps that are not built")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merges = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        char = {b: c for c, b in byte_alphabet().items()}
        self.inner = [vocab[char[b]] for b in range(256)]
        self.last = [vocab[char[b] + end] for b in range(256)]
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in spec["added_tokens"]}
        self.pieces = {i: p for p, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        # letters and numbers newer than the Unicode version of ``unicodedata`` count as other characters
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        new = {ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(sorted(c for c in new if c - 1 not in new), sorted(c for c in new if c + 1 not in new), strict=True))
        pattern = cuts[0]["pattern"]["Regex"].replace("\\s", WHITE)
        for kind in ("\\p{L}", "\\p{N}"):
            pattern = pattern.replace(f"[{kind}]", f"[{kind}--[{ranges}]]")
        pattern = pattern.replace(f"[^{WHITE}\\p{{L}}\\p{{N}}]", f"[^{WHITE}[\\p{{L}}\\p{{N}}--[{ranges}]]]") if ranges else pattern
        self.words = regex.compile(pattern, regex.V1)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cached_word, self.cached_run = lru_cache(2 * CACHE)(self.word), lru_cache(CACHE)(self.run)

    def word(self, word: str) -> bytes:
        """Ids of one word, packed."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, merges = len(ids), self.merges
        if n == 1:
            return array("I", ids).tobytes()
        leaves = [_NONE] * (n - 1)
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            got = merges.get((left << 32) | right)
            if got:
                leaves[i] = (got[0] << 32) | i
            left = right
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
        root, deep = levels[-1], len(levels) > 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := min(root)) != _NONE:
            i = least & 0xFFFFFFFF
            j = after[i]
            merged = ids[i] = merges[(ids[i] << 32) | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            p = before[i]
            # the pair at i changes, the one at j ends, the one before changes
            got = None
            if k < n:
                before[k] = i
                leaves[j] = _NONE
                got = merges.get((merged << 32) | ids[k])
            leaves[i] = (got[0] << 32) | i if got else _NONE
            if p >= 0:
                got = merges.get((ids[p] << 32) | merged)
                leaves[p] = (got[0] << 32) | p if got else _NONE
            if deep:
                changed = {x // FAN for x in (p, i, j) if 0 <= x < n - 1}
                for below, level in zip(levels, levels[1:], strict=False):
                    for x in changed:
                        level[x] = min(below[x * FAN : x * FAN + FAN])
                    changed = {x // FAN for x in changed}
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def run(self, run: str) -> bytes:
        """Ids of what stands between two white spaces; no word holds any."""
        # letters alone are one word, letters and a mark two: most runs need no pattern
        if len(run) <= SHORT and run.isalpha():
            return self.cached_word(run)
        if len(run) <= SHORT and run[:-1].isalpha() and run[-1] in ".,;:!?":
            return self.cached_word(run[:-1]) + self.cached_word(run[-1])
        return b"".join([self.cached_word(w) if len(w) <= SHORT else self.word(w) for w in self.words.findall(run)])

    def plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without words that stand for themselves, a block of runs at a time."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case knows no final sigma here
        text = text.lower()
        if len(text) < 1 << 20 and not _SEPARATORS.search(text):
            found = iter(text.split())
        else:
            found = (m.group() for m in _RUNS.finditer(text))
        one = lambda w: self.cached_run(w) if len(w) <= SHORT else self.run(w)
        while runs := list(islice(found, BLOCK)):
            yield b"".join(map(one, runs))

    def encode(self, text: str) -> bytes:
        parts = self.apart.split(text) if self.apart else [text]
        return b"".join(x for p in parts if p for x in ([self.added[p]] if p in self.added else self.plain(p)))

    def decode(self, ids: bytes) -> str:
        """Pieces joined by a space, as without a decoder. An id without a piece is left out."""
        pieces = self.pieces
        return " ".join(pieces[i] for i in np.frombuffer(ids, "<u4").tolist() if i in pieces)


@lru_cache(2)
def _bpe(source: bytes) -> Bpe:
    return Bpe(source)


def _with_column(rows: DataFrame, of: str, name: str, kind: str, path: str, call: str) -> DataFrame:
    name = fresh(rows.columns, name)
    with open(path, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = getattr(_bpe(held.value), call)
        for b in batches:
            values = b.column(of)
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                new = pa.array([made(v.as_py() or ("" if call == "encode" else b"")) for v in values[at : at + 256]], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, new], schema=part.schema.append(pa.field(name, arrow)))

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` {kind}")


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as packed little-endian unsigned 32-bit integers (``numpy.frombuffer(ids, '<u4')``).

    Null and empty texts have no ids. Special words of the vocabulary inside a text become their own ids; none is added.
    Rows, order and columns stay; where ``name`` is taken the new column is ``_name``. The file is read on the driver.
    """
    return _with_column(docs, text, name, "binary", path, "encode")


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of each packed id sequence: its pieces joined by a space. Null ids give an empty text."""
    return _with_column(rows, ids, name, "string", path, "decode")
