"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A byte-level tokenizer splits text before every space that a visible
character follows, and a word tokenizer drops white space; so a text is cut
there and the pieces' ids are put end to end, which gives the ids of the
whole text.  Both kinds of tokenizer also split between a letter or digit and
an ASCII mark other than the apostrophe, so a piece's closing marks are
encoded apart from the rest; the rest, when it is one run of Latin letters,
is one unit of the merge rules and goes to them directly.  A text that holds a special
token's string is encoded whole.  A null text is an empty one.  Ids are kept as
bytes, two each where the vocabulary allows it, and put end to end by Arrow's
take of binary values.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

def spread(first: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... (``times`` of them) for every entry, end to end, and where each entry's lie (one more)."""
    starts = np.concatenate([[0], np.cumsum(times)])
    total = int(starts[-1])
    small = np.int32 if max(total, int((first + times).max(initial=0))) < 2**31 else np.int64
    at = np.repeat((first - starts[:-1]).astype(small), times)
    at += np.arange(total, dtype=small)
    return at, starts


#: Units a worker remembers; the older half goes when there are more.
KNOWN = 600_000
#: ASCII marks but the apostrophe, which may open a contraction.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


def joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary or string array end to end, and where each value's lie (one more)."""
    _, ends, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[: starts[-1]] if data else np.zeros(0, np.uint8), starts


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte; printable Latin-1 stands for itself."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Encoder:
    """Ids of many texts; ``by_word`` for tokenizers that drop white space."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.by_word = by_word
        self.lowers = by_word and "Lowercase" in str(self.tokenizer.normalizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(r"(?= [^\s])")
        # one pre-token that normalization leaves as it is
        self.letters = re.compile("[a-zß-öø-ÿ]+" if by_word else " ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
        self.bytes = byte_letters()
        # ids as bytes
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        """Encode units and remember them."""
        tokenize, letters, table, kind = self.merges.tokenize, self.letters.fullmatch, self.bytes, self.kind
        other = []
        for unit in units:
            if not letters(unit):
                other.append(unit)
                continue
            plain = unit if self.by_word and unit.isascii() else unit.encode().decode("latin-1").translate(table)
            self.new[unit] = array(kind, [t.id for t in tokenize(plain)]).tobytes()
        if other:
            self.new.update((u, array(kind, e.ids).tobytes()) for u, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)))

    def _lookup(self, units: list[str]) -> list[bytes]:
        """The ids of each unit."""
        if len(self.new) > KNOWN // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, units))
        away = [i for i, ids in enumerate(found) if ids is None]
        if away:
            asked = [units[i] for i in away]
            before = [(unit, old[unit]) for unit in asked if unit in old]
            new.update(before)
            self._learn([unit for unit in asked if unit not in old] if before else asked)
            for i, unit in zip(away, asked):
                found[i] = new[unit]
        return found

    def _units(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each piece without its closing marks, and these (empty where the boundary is not sure)."""
        core = pc.ascii_rtrim(pieces, MARKS)
        sure = pc.match_substring_regex(core, r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]$")
        core = pc.if_else(sure, core, pieces)
        data, starts = joined(pieces)
        n = np.asarray(pc.binary_length(core))
        at, ends = spread(starts[:-1] + n, np.diff(starts) - n)
        return core, pa.Array.from_buffers(pieces.type, len(pieces), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at])])

    def _pool(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as bytes."""
        core, marks = self._units(pieces)
        core, marks = core.dictionary_encode(), marks.dictionary_encode()
        # marks may be units too: each is looked up once
        strings = [part.dictionary.to_numpy(zero_copy_only=False).tolist() for part in (core, marks)]  # far quicker than to_pylist
        units = pa.array(self._lookup(strings[0]) + self._lookup(strings[1]), pa.large_binary())
        both = np.stack([np.asarray(core.indices), np.asarray(marks.indices) + len(core.dictionary)], axis=1).reshape(-1)
        data, starts = joined(units.take(pa.array(both)))
        return pa.Array.from_buffers(units.type, len(pieces), [None, pa.py_buffer(starts[::2].copy()), pa.py_buffer(data)])

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, and the number of them in each."""
        if self.by_word:
            lists = pc.ascii_split_whitespace(texts)
            return lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        # quick where every space has a visible ASCII or Latin letter after it; by expression elsewhere
        odd = np.asarray(pc.match_substring_regex(texts, r" ([^\x21-\x7e\x{a1}-\x{24f}]|$)"))
        lists = pc.split_pattern(texts, " ")
        lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        flat = lists.flatten()
        first = np.zeros(len(flat), bool)
        starts = np.cumsum(lengths) - lengths
        first[starts[lengths > 0]] = True
        spaced = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(pa.scalar(" ", flat.type), flat, pa.scalar("", flat.type)))
        if not odd.any():
            return spaced, lengths
        out, n = [], lengths.copy()
        ends = starts + lengths
        at = 0
        for i in np.flatnonzero(odd).tolist():
            out.append(spaced.slice(at, starts[i] - at))
            own = [x for x in self.cut.split(texts[i].as_py())]
            out.append(pa.array(own, flat.type))
            n[i] = len(own)
            at = int(ends[i])
        out.append(spaced.slice(at))
        return pa.concat_arrays(out), n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where those of each text start (one entry more)."""
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts).cast(pa.large_string())  # before the cast: a cast slice keeps its old offsets
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= np.asarray(pc.match_substring(lower, s.lower()))
        # in lower case as the tokenizer would have it: fewer distinct pieces
        plain = lower if self.lowers else texts
        if whole.any():
            plain = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), plain)
        pieces, n = self._pieces(plain)
        coded = pieces.dictionary_encode()
        data, piece_starts = joined(self._pool(coded.dictionary).take(coded.indices))
        ids = data.view(self.kind)
        starts = piece_starts[np.concatenate([[0], np.cumsum(n)])] // ids.itemsize
        if whole.any():
            parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:])]
            for i in np.flatnonzero(whole).tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=ids.dtype)
            ids = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, starts


def encoder(path: str, by_word: bool) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return kept(("ids", path, by_word), lambda: Encoder(path, by_word))
