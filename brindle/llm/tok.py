"""Encode whole texts with a tokenizers file, through a cache of the pieces between single blanks.

A single blank or line end between two characters that are no white space always starts a new pre-token in the two
tokenizer files used here, and so does the change from letters to other signs; the ids of a text are those of its pieces,
one after the other. Longer or other white space stays inside a piece. Only pieces that the cache does not hold reach the
library. A key is a piece without its leading blank; ``\\0`` marks the first piece of a text, which has none, and ``\\1`` a
piece that is taken as it is.

A batch of texts is cut and its distinct pieces are numbered by Arrow; numpy then copies each piece's ids to its places.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from brindle.llm.common import process_cache
from brindle.llm.spans import joined

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
WORD = rf"^\x00?{LETTERS}$"
# A word at the beginning of a text or line, or behind a blank, with one sign behind it; or one at the beginning of a line.
COMPOUND = rf"^(?:[\x00\n]?{LETTERS}[.,]|\n{LETTERS})$"
CACHE_ENTRIES = 1_000_000  # a fuller cache starts anew
SLICE = 16 << 20  # bytes of text that are encoded at once


def load(path: str):
    from tokenizers import Tokenizer

    held = process_cache("tokenizers")
    if path not in held:
        held[path] = Tokenizer.from_file(path)
        held[path].encode_special_tokens = True
    return held[path]


def keys(text: str) -> list[str]:
    """The keys of any text."""
    if re.search(r"[\0-\2\x1c-\x1f\x85]", text):
        return ["\1" + text]
    out = []
    for k, piece in enumerate(CUT.split(text)):
        body = piece[1:] if k else piece
        out.append("\1" + piece if body.split() != [body] else "\0" + body if not k else piece if piece[0] == "\n" else body)
    return out


def _plain(key: str) -> bool:
    body = key[1:] if key[0] in "\0\n" else key
    return body.split() == [body] and "\0" not in body and "\1" not in body


# How byte-level tokenizers write bytes: printable ones as themselves, the others by turns from 256.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
PROBES = ("the", "Éa", "ßü", "McX", "zqxj", "l", "t", "À")


def _strings(values):
    import pyarrow as pa

    return pa.array(values, pa.large_string())


class Cache:
    """Ids of pieces by number: ``keys`` in order of their numbers, and for each where its ids begin in the pool and how many they are."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        # Plain words can go to the library's model at once, if one of the two known ways to write them proves right.
        ways = ((BYTES[32], str), ("", str.lower))
        right = [w for w in ways if all(array("I", self._words([x], w)[0]).tobytes() == y for p in PROBES for x, y in zip((p, "\0" + p), self._ids([" " + p, p])))]
        self.way = right[0] if right else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.count = _strings([]), 0
        self.start, self.size, self.odd = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0
        # An empty text; then nothing and the signs that compounds have.
        ids = [b"", b"", *self._ids(["\n", ".", ","])]
        self._put(_strings(["\0", "\2", "\2\n", "\2.", "\2,"]), np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) // 4 for x in ids]))

    def _words(self, keys_: list[str], way) -> tuple[list[int], list[int]]:
        """Ids of plain words, one word after the other, and how many each has."""
        blank, case = way
        tokenize, flat, size = self.tokenizer.model.tokenize, [], []
        for key in keys_:
            word = case(key[1:] if key[0] == "\0" else key)
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(BYTES)
            found = [t.id for t in tokenize(word if key[0] == "\0" else blank + word)]
            flat += found
            size.append(len(found))
        return flat, size

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, keys_, flat: np.ndarray, size: np.ndarray, odd: np.ndarray | None = None) -> None:
        """Add new keys with their ids."""
        import pyarrow as pa

        first, last = self.count, self.count + len(keys_)
        while len(self.start) < last:
            self.start, self.size, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.odd))
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.keys, self.count = pa.concat_arrays([self.keys, keys_]), last
        self.size[first:last] = size
        self.start[first:last] = self.used + np.cumsum(size) - size
        self.odd[first:last] = False if odd is None else odd
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _put_bytes(self, names: list[str], ids: list[bytes], odd: np.ndarray | None = None) -> None:
        self._put(_strings(names), np.frombuffer(b"".join(ids), np.uint32), np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)), odd)

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys of these numbers, one after the other, and where each one's begin (and the last end)."""
        size = self.size[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[number] - ends[:-1], size)
        at += np.arange(ends[-1])
        return self.pool[at], ends

    def numbers(self, pieces) -> np.ndarray:
        """The number of each of these different strings; new ones are added."""
        import pyarrow.compute as pc

        known = pc.index_in(pieces, value_set=self.keys)
        if known.null_count:
            was = self.count
            new = pieces.filter(pc.is_null(known))
            self._add(new)
            number = pc.fill_null(known, 0).to_numpy().astype(np.int64)
            number[known.is_null().to_numpy(zero_copy_only=False)] = was + pc.index_in(new, value_set=self.keys.slice(was)).to_numpy()
            return number
        return known.to_numpy().astype(np.int64)

    def _add(self, new) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(new, WORD) if self.way else pa.array(np.zeros(len(new), bool))
        compound = pc.match_substring_regex(new, COMPOUND) if self.way else plain
        other = new.filter(pc.invert(pc.or_(plain, compound))).to_pylist()
        odd = np.fromiter((k[:1] != "\1" and not (k and _plain(k)) for k in other), bool, len(other))
        texts = [k[1:] if k[0] in "\0\1" else k if k[0] == "\n" else " " + k for k, o in zip(other, odd) if not o]
        ids = iter([x for at in range(0, len(texts), 20_000) for x in self._ids(texts[at : at + 20_000])])
        self._put_bytes(other, [b"" if o else next(ids) for o in odd], odd)
        # The words that compounds are made of are keys too.
        compounds = new.filter(compound)
        words = pc.replace_substring_regex(pc.ascii_rtrim(compounds, characters=".,"), "^\n", "\x00")
        wanted = pc.unique(pa.concat_arrays([new.filter(plain), words]))
        names = wanted.filter(pc.is_null(pc.index_in(wanted, value_set=self.keys))).to_pylist()
        flat, size = self._words(names, self.way) if names else ([], [])
        self._put(_strings(names), np.array(flat, np.uint32), np.array(size, np.int64))
        if len(compounds):
            parts = np.ones((len(compounds), 3), np.int64)
            parts[pc.starts_with(compounds, "\n").to_numpy(zero_copy_only=False), 0] = 2
            parts[:, 1] = pc.index_in(words, value_set=self.keys).to_numpy()
            parts[pc.ends_with(compounds, ".").to_numpy(zero_copy_only=False), 2] = 3
            parts[pc.ends_with(compounds, ",").to_numpy(zero_copy_only=False), 2] = 4
            flat, begins = self.gather(parts.reshape(-1))
            self._put(compounds, flat, np.diff(begins[::3]))


def _marked(text) -> bool:
    """Whether any text holds a sign that marks keys."""
    data, _ = joined(text)
    return len(data) > 0 and int(data.min()) <= 2


def encode(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of an Arrow string column's texts, one text after the other, and where each begins (and the last ends); a null text has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = process_cache("ids")
    if path not in held:
        held[path] = Cache(path)
    cache = held[path]
    if cache.count > CACHE_ENTRIES:
        cache.clear()
    text = pc.fill_null(column.cast(pa.large_string()), "")
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    first, nothing = _strings(["\0", ""])
    lists = pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(text, "\n", " \n"), nothing), " ")
    pieces = lists.flatten().dictionary_encode()
    cuts = lists.offsets.to_numpy().astype(np.int64)
    cuts -= cuts[0]
    number = cache.numbers(pieces.dictionary)[pieces.indices.to_numpy()]
    # Texts with a piece that is no key, or with a sign that marks one, are cut by keys().
    again = np.unique(np.searchsorted(cuts, np.flatnonzero(cache.odd[number]), side="right") - 1)
    if _marked(text):
        again = np.union1d(again, np.flatnonzero(pc.match_substring_regex(text, "[\\x00-\\x02]").to_numpy(zero_copy_only=False)))
    if len(again):
        parts, at, sizes = [], 0, np.diff(cuts)
        own = [keys(text[i].as_py()) for i in again.tolist()]
        flat = _strings([k for x in own for k in x]).dictionary_encode()
        flat = cache.numbers(flat.dictionary)[flat.indices.to_numpy()]
        done = 0
        for i, x in zip(again.tolist(), own):
            parts += [number[at : cuts[i]], flat[done : done + len(x)]]
            at, sizes[i], done = cuts[i + 1], len(x), done + len(x)
        number = np.concatenate([*parts, number[at:]])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
    ids, begins = cache.gather(number)
    return ids, begins[cuts]


def ended(ids: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text."""
    return np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))
