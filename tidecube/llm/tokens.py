"""Whole texts to token ids with a public byte-level BPE tokenizer, many texts at a time."""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts texts while they are cut; texts that hold it are encoded whole.
CUT = "\x01"
#: Parts pieces that are encoded together: always a token of its own between pieces that hold no tab.
TAB = "\t"
JOINED = 2000
#: Pieces that are a line break or none, one word of Latin letters or figures and ASCII marks after it, but for the
#: apostrophe: words of the tokenizer whatever Unicode version it has.
PLAIN = re.compile(r"(\n?)( ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+))([!-&(-/:-@\[-`{-~]*)")
#: Pieces whose ids are kept from slice to slice: the last ones used, this many at least.
KEPT = 150_000
#: Pieces that keep a text from being cut: empty but for the break or space before, with other white space at an end or a
#: tab inside.
SPACES = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
APART = rf"^[ \n]?$|^[ \n]?[{SPACES}]|[{SPACES}]$|\t"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes batches of texts, each distinct piece of a batch once.

    The tokenizer's words never begin with white space other than one space, and a single space or line break between
    two other characters always begins a word or is one. So texts can be cut before these without changing ids. Where
    white space meets white space, or a token stands that the tokenizer looks for in the text itself, the whole text is
    encoded by itself. special: special tokens in a text are such tokens, as the library has it; else they are plain text.
    """

    def __init__(self, path: str, special: bool = False, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        tab = self.tokenizer.encode(TAB, add_special_tokens=False).ids
        before = self.tokenizer.pre_tokenizer
        byte_level = self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and not before.add_prefix_space and before.use_regex
        self.tab = tab[0] if len(tab) == 1 and byte_level and not any(TAB in x for x in self.added) else None
        self.model, self.letters, self.kept = self.tokenizer.model, byte_letters(), kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, text: str) -> bytes:
        """Ids of a word of the tokenizer, whose letters are spelled in bytes for its model."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        elif text[0] in " \n":
            text = self.letters[ord(text[0])] + text[1:]
        return array("i", [x.id for x in self.model.tokenize(text)]).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of a word that is a part of pieces."""
        found = self.young.get(text) or self.old.get(text)
        if found is None:
            found = self.young[text] = self.word(text)
        return found

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of each piece. Words share their ids with the pieces that have a break before or marks after them; pieces that
        are no such words are encoded as they are, parted by tabs."""
        young, old = self.young, self.old
        table, others = list(map(young.get, texts)), []
        for i, found in enumerate(table):
            if found is None:
                t = texts[i]
                found = old.get(t)
                if found is None:
                    m = PLAIN.fullmatch(t)
                    if m is None:
                        others.append(i)
                        continue
                    line, word, marks = m.groups()
                    found = self.word(t) if not (line or marks) else (self.part(line) if line else b"") + self.part(word) + (self.part(marks) if marks else b"")
                young[t] = table[i] = found
        for k in range(0, len(others), 8 * JOINED):
            part = others[k : k + 8 * JOINED]
            runs = [[texts[i] for i in part[j : j + JOINED]] for j in range(0, len(part), JOINED)]
            ids = np.concatenate(self.whole([TAB.join(r) + TAB for r in runs]))
            ends, data = np.flatnonzero(ids == self.tab).tolist(), ids.tobytes()
            for i, a, b in zip(part, [-1, *ends], ends):
                self.young[texts[i]] = table[i] = data[4 * a + 4 : 4 * b]
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        return table

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (int32), and the number of ids of each."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        column = pa.array(texts, pa.string())
        odd = np.asarray(pc.match_substring_regex(column, "|".join(map(re.escape, [CUT, *self.added])))) if self.tab is not None else np.ones(len(texts), bool)
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(column, " ", CUT + " "), "\n", CUT + "\n"), CUT)
        offsets, coded = np.asarray(lists.offsets), lists.values.dictionary_encode()
        del lists, column
        codes = np.asarray(coded.indices)
        apart = np.asarray(pc.match_substring_regex(coded.dictionary, APART))
        if apart.any():
            odd = odd | np.logical_or.reduceat(apart[codes], offsets[:-1])
        if odd.any():
            some = np.flatnonzero(odd).tolist()
            whole = dict(zip(some, self.whole([texts[i] for i in some])))
            ids, counts = self.encode([t for i, t in enumerate(texts) if i not in whole])
            parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            each = [whole[i] if i in whole else next(parts) for i in range(len(texts))]
            return np.concatenate(each).astype(np.int32), np.array([len(x) for x in each], np.int64)
        table = self.pieces(coded.dictionary.to_pylist())
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, table), np.int64, len(table)) // 4)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(begins, pa.array(np.frombuffer(b"".join(table), np.int32))).take(coded.indices)
        return np.asarray(ids.values), np.diff(np.asarray(ids.offsets)[offsets].astype(np.int64))


@functools.lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder for each worker process and kind."""
    return Encoder(path, special)


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each text's, and where each text's end."""
    ends = np.cumsum(counts + 1)
    out = np.full(len(ids) + len(counts), end_id, np.int32)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """(row number, texts) of consecutive rows with about limit bytes at a time; null texts are empty."""
    values = batch.column(column)
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64))
    first = 0
    while first < len(values):
        before = sizes[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, pc.fill_null(values.slice(first, stop - first), "").to_pylist()
        first = stop
