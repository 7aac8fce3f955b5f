"""Encoding with public tokenizer files inside Arrow functions.

A byte-level BPE without normalizer never merges across a place where a space follows a
non-space character, so a text is the concatenation of its space-led units. The units of a
batch are dictionary-encoded by Arrow and each distinct unit goes through the tokenizer
library once; a text's ids are then gathered with numpy. A worker remembers units that a batch
had more than once, as most others never come again. Texts in which a space follows other white
space, and all texts of other kinds of tokenizer, go to the library whole (byte-level ones cut
at safe places if they are long).
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The White_Space characters of Unicode, as the tokenizers' pattern ``\s`` has them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"
_HAZARD, _ENDS = _WHITE + " ", f"^$|{_WHITE}\\z"
#: Bytes of text that are encoded at a time, and of a piece of a long text.
BATCH_BYTES, PIECE_CHARS = 2 << 20, 1 << 18
#: Distinct units, and bytes of them, that a worker remembers; beyond, it keeps those of the batch at hand.
CACHE_UNITS, CACHE_BYTES = 450_000, 14 << 20
#: Units in a text for the library, and such texts at a time.
_CHUNK, _CHUNKS = 256, 16
_loaded: dict = {}


def tokenizer_file(path: str) -> tuple[str, bytes]:
    """Kind and content of a tokenizer file, read at the driver and shipped with the function."""
    with open(path, "rb") as f:
        return os.path.splitext(path)[1], f.read()


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """``text`` cut before spaces that follow a non-space character, at most about ``limit`` characters each.

    Without such a place the rest stays whole. The pieces' concatenation is the text.
    """
    out, start, at = [], 0, limit
    while at < len(text):
        cut = text.find(" ", at)
        while cut > 0 and text[cut - 1] in WHITE:
            cut = text.find(" ", cut + 1)
        if cut <= 0:
            break
        out.append(text[start:cut])
        start, at = cut, cut + limit
    out.append(text[start:])
    return out


class ByteUnits:
    """Ids of texts by their space-led units; see the module's text.

    Units stay in Arrow's buffers from the split to the library's input; none becomes a Python string of its own.
    """

    def __init__(self, tok):
        self.tok = tok
        vocab = tok.get_vocab(with_added_tokens=True)
        self.led = np.zeros(max(vocab.values()) + 1, bool)
        for t, i in vocab.items():
            self.led[i] = t.startswith("Ġ")  # the byte alphabet's space
        self.forget()

    def forget(self):
        """Forget all units."""
        self.known = pa.array([], pa.string())
        self.ids, self.len = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and each text's number of them."""
        ids, lens = [np.zeros(0, np.uint32)], []
        for k in range(0, len(texts), _CHUNKS * _CHUNK):
            got = self.whole(texts[k : k + _CHUNKS * _CHUNK])
            ids.append(np.concatenate(got))
            lens += map(len, got)
        return np.concatenate(ids), np.array(lens, np.int64)

    def _learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for space-led units that end in no white space, many of them in a text."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        cuts = np.minimum(np.arange(0, len(units) + _CHUNK, _CHUNK), len(units)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), units), " ")
        for k in range(0, len(joined), _CHUNKS):
            for i, got in enumerate(self.whole([" " + x for x in joined.slice(k, _CHUNKS).to_pylist()]), k):
                first = np.flatnonzero(self.led[got])
                if len(first) == cuts[i + 1] - cuts[i]:
                    n = np.diff(first, append=len(got))
                else:
                    got, n = self._alone([" " + u for u in units[cuts[i] : cuts[i + 1]].to_pylist()])
                ids.append(got)
                lens.append(n)
        return np.concatenate(ids), np.concatenate(lens)

    def by_slot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of hazard-free texts: slots of all units, one text after the other; each text's first place; ids and lengths of the slots."""
        lists = pc.split_pattern(texts, " ")
        first = (lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1]
        flat = lists.flatten().dictionary_encode()
        del lists
        distinct, unit = flat.dictionary, flat.indices.to_numpy()
        del flat
        # a text's first unit has no space before it
        heads, head = np.unique(unit[first], return_inverse=True)
        often = np.bincount(unit, minlength=len(distinct)) - np.bincount(unit[first], minlength=len(distinct))
        slot = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        old = slot >= 0
        new = ~old & (often > 0)
        alone = new & np.asarray(pc.match_substring_regex(distinct, _ENDS))
        parts, lens, n = [self.ids], [self.len], len(self.known)
        for places, learn in ((np.flatnonzero(new & ~alone), self._learn), (np.flatnonzero(alone), lambda u: self._alone([" " + x for x in u.to_pylist()])), (heads, lambda u: self._alone(u.to_pylist()))):
            got, k = learn(distinct.take(pa.array(places)))
            parts.append(got)
            lens.append(k)
            if places is not heads:
                slot[places] = np.arange(n, n + len(places))
                n += len(places)
        ids, lens = np.concatenate(parts), np.concatenate(lens)
        slots = slot[unit]
        slots[first] = n + head
        self._remember(distinct, slot, old & (often > 0), new & (often > 1), ids, lens)
        return slots, first, ids, lens

    def _remember(self, distinct: pa.Array, slot: np.ndarray, met: np.ndarray, more: np.ndarray, ids: np.ndarray, lens: np.ndarray):
        """Add the units of ``more`` to the known ones; if these are too many, keep those of ``met`` and ``more``, or forget all."""
        mine = np.flatnonzero(met | more)
        some, slots = distinct.take(pa.array(mine)), slot[mine]
        idle = np.ones(len(self.known), bool)
        idle[slot[met]] = False
        rest = self.known.filter(pa.array(idle))
        if len(some) + len(rest) <= CACHE_UNITS and some.nbytes + rest.nbytes <= CACHE_BYTES:
            some, slots = pa.concat_arrays([some, rest]), np.append(slots, np.flatnonzero(idle))
        elif len(some) > CACHE_UNITS or some.nbytes > CACHE_BYTES:
            return self.forget()
        self.known, self.ids, self.len = some, _flat(slots, ids, lens), lens[slots]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        slots, first, _, lens = self.by_slot(texts)
        return np.add.reduceat(lens[slots], first)

    def gather(self, texts: pa.Array) -> list[np.ndarray]:
        slots, first, ids, lens = self.by_slot(texts)
        return np.split(_flat(slots, ids, lens), np.cumsum(np.add.reduceat(lens[slots], first))[:-1])


def _flat(slots: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The ids of slots, one after the other; ``lens``: how many of ``ids`` each slot has."""
    n = lens[slots]
    shift = (np.cumsum(lens) - lens)[slots] - (np.cumsum(n) - n)
    at = np.repeat(shift, n)
    at += np.arange(len(at))
    return ids[at]


class Encoder:
    """Lengths or ids of texts for a tokenizer file's kind and content."""

    def __init__(self, kind: str, content: bytes):
        self.units = None
        if kind == ".model":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.whole = lambda texts: [np.array(x, np.uint32) for x in sp.encode(texts, num_threads=1)]
        elif kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok, spec = Tokenizer.from_str(content.decode()), json.loads(content)
            tok.no_truncation()
            tok.no_padding()
            self.whole = lambda texts: [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            pre = spec.get("pre_tokenizer") or {}
            clean = all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) and not set(t["content"]) & set(WHITE) for t in spec.get("added_tokens", []))
            if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("normalizer") and clean:
                self.units = ByteUnits(tok)
        else:
            raise ValueError(f"no library for a tokenizer file of kind {kind!r}")

    def run(self, texts: pa.Array, lengths: bool) -> list:
        """Per text its number of ids, or its ids. Texts are not null."""
        return [x for _, got in self.groups(texts, lengths) for x in got]

    def groups(self, texts: pa.Array, lengths: bool):
        """The same for groups of texts that are balanced by bytes: (first text's place, results)."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield a, self._some(texts.slice(a, b - a), size[a:b], lengths)

    def _some(self, texts: pa.Array, size: np.ndarray, lengths: bool) -> list:
        out = [None] * len(texts)
        odd = np.ones(len(texts), bool) if self.units is None else np.asarray(pc.match_substring_regex(texts, _HAZARD)) | (size > 4 * PIECE_CHARS)
        even = np.flatnonzero(~odd)
        if len(even):
            some = texts.take(pa.array(even))
            for i, x in zip(even, self.units.lengths(some).tolist() if lengths else self.units.gather(some)):
                out[i] = x
        for i in np.flatnonzero(odd):
            got = self._long(texts[int(i)].as_py())
            out[i] = sum(map(len, got)) if lengths else np.concatenate(got)
        return out

    def _long(self, text: str) -> list[np.ndarray]:
        got = []
        for piece in safe_pieces(text) if self.units is not None else [text]:
            if self.units is None or pc.match_substring_regex(pa.array([piece]), _HAZARD)[0].as_py():
                got += self.whole([piece])
            else:
                got += self.units.gather(pa.array([piece]))
        return got


def encoder(kind: str, content: bytes) -> Encoder:
    """The worker's encoder for a file; kept between tasks."""
    key = (kind, hash(content))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(kind, content)
    return _loaded[key]


def plain_text(column) -> pa.Array:
    """A text column with nulls as empty texts."""
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column
