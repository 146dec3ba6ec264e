"""Exact merge-type subword encoding by backtracking, and decoding.

The model's merges are greedy: of all neighbouring symbols whose concatenation is a piece, the best scored (leftmost
among equals) merges first. A token sequence is what these merges give exactly if every two neighbours, merged from
characters on their own, stay those two tokens. So encoding walks left to right: at each position it tries the pieces
that start there (all found by one Aho-Corasick pass), longest first, keeps the first compatible with its predecessor
and steps back where none fits. The encoding of a prefix is unique, so a position that failed once has failed for good;
a bitfield holds those.

No merge crosses two neighbouring bytes that no piece holds side by side, so texts are cut there: before each run of
spaces, around line ends, digits and most punctuation. Each distinct part is encoded once per worker and kept in a
bounded cache.

That takes a walk in Python per part, and most distinct words of a large corpus occur once. So the short parts that a slice
of rows needs and the cache lacks are merged together instead, as the definition says, in arrays with a column per part:
each round makes every part's best merge. Longer parts, for which merging would be quadratic, are walked as above.

Rows are taken together as bytes in arrays, too: parts are looked up by a hash, and their ids and the bytes that these
decode to are gathered for all rows at once. The decoded bytes must be those of the rows, part by part, which shows that no
two parts met under one hash; where they differ, and for very long rows, rows are encoded one by one.

Null and empty texts encode to the end id alone. Texts may be of any length. Rows are encoded one by one, so repeated
rows get the same ids and null ids pass through; an empty table gives an empty result. Other columns than id and text are
not carried, so clashing names can't arise.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import int_lists, read, slices, strings, utf8

MARK = "▁"
#: Distinct parts that a worker keeps; beyond them its cache starts anew.
CACHE_PARTS = 400_000
#: Longer parts are encoded each time they occur.
CACHE_CHARS = 48
#: Parts that are merged together; their arrays stay in a core's cache.
MERGE_PARTS = 4_096
#: Bytes of text that are encoded together; arrays take some 60 times as much. Longer rows are encoded one by one.
GROUP_BYTES = 1 << 20
#: Distinct parts, and ids of them, that a worker keeps in arrays; beyond them they start anew.
KNOWN_PARTS = 1 << 19
KNOWN_IDS = 1 << 23
#: Bytes of the longest part that is hashed in arrays.
HASH_BYTES = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(padded: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """63-bit hashes of the parts of a buffer that has 8 bytes more than they reach."""
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    h = width.astype(np.uint64)
    left = np.arange(len(at))
    for k in range(0, HASH_BYTES, 8):
        x = (h[left] ^ (eight[at[left] + k] & _FIRST_BYTES[np.minimum(width[left] - k, 8)])) * _ODD
        h[left] = x ^ (x >> np.uint64(29))
        left = left[width[left] > k + 8]
        if not len(left):
            break
    h = (h >> np.uint64(1)).astype(np.int64)
    for i in left.tolist():
        h[i] = hash(padded[at[i] : at[i] + width[i]].tobytes()) & np.iinfo(np.int64).max
    return h


def _gathered(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """`count` values of the pool from each `first` on, end to end."""
    index = np.repeat(first - (np.cumsum(count) - count), count)
    index += np.arange(len(index))
    return pool[index]


class _Table:
    """Numbers from 0 on, each with a value, by open addressing."""

    def __init__(self, bits: int, missing: int):
        self.bits, self.missing = bits, missing
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Keys, each once, that the table lacks."""
        slot = self._slot(key)
        while len(key):
            while (taken := (self.keys[slot] >= 0)).any():
                slot[taken] = (slot[taken] + 1) & (len(self.keys) - 1)
            slots, first = np.unique(slot, return_index=True)
            self.keys[slots], self.values[slots] = key[first], value[first]
            wait = np.ones(len(key), np.bool_)
            wait[first] = False
            key, value, slot = key[wait], value[wait], slot[wait]

    def find(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], self.missing)
        wait = np.flatnonzero((held != key) & (held >= 0))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[wait]]
            same = held == key[wait]
            out[wait[same]] = self.values[slot[wait[same]]]
            wait = wait[~same & (held >= 0)]
        return out


class _Known:
    """Ids of the parts that a worker has met, in arrays; number 0 is what ends a row."""

    def __init__(self, end: list[int]):
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.table = _Table(KNOWN_PARTS.bit_length(), -1)
        self.first, self.count, self.width = np.zeros((3, KNOWN_PARTS + 1), np.int64)
        self.pool = np.zeros(1 << 20, np.int32)
        self.pool[: len(self.end)] = self.end
        self.count[0] = self.used = len(self.end)
        self.parts = 1

    def has_room(self, more: int) -> bool:
        return self.parts + more <= KNOWN_PARTS and self.used <= KNOWN_IDS

    def add(self, key: np.ndarray, width: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New parts: their hashes, bytes, numbers of ids, and ids end to end."""
        at = np.arange(self.parts, self.parts + len(key))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[at], self.count[at], self.width[at] = self.used + np.cumsum(count) - count, count, width
        self.used += len(ids)
        self.parts += len(key)
        self.table.add(key, at)


class _Merges:
    """Greedy merging of many short parts at once, a column of arrays each.

    A symbol is a piece's id or, for a character that is no piece, PLAIN plus its code point. A merge is one number: rank
    of the score, place in the part, piece; so the least of a column is its best merge, the leftmost among equals.
    """

    PLAIN = 1 << 20
    NONE = PLAIN + 0x110000
    SYMBOL_BITS, PLACE_BITS = 22, 6
    NEVER = np.int64(np.iinfo(np.int64).max)

    def __init__(self, ids: dict[str, int], score: dict[str, float]):
        self.char = np.arange(self.PLAIN, self.NONE, dtype=np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbol = {**{c: self.PLAIN + ord(c) for piece in ids for c in piece}, **ids}
        keys, values = [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << self.SYMBOL_BITS | right)
                    values.append(rank[score[piece]] << (self.SYMBOL_BITS + self.PLACE_BITS) | i)
        self.table = _Table(max(4, len(keys).bit_length() + 3), self.NEVER)
        self.table.add(np.array(keys, np.int64), np.array(values, np.int64))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge of each pair with place 0; NEVER without one."""
        return self.table.find(left << self.SYMBOL_BITS | right)

    def __call__(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of parts (code points end to end; none empty, each shorter than 62): their numbers, their symbols end to end, and how many each has."""
        symbols = self.char[codes]
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(lengths), MERGE_PARTS):
            chosen = order[at : at + MERGE_PARTS]
            yield chosen, *self._merged(symbols, starts[chosen], lengths[chosen])

    def _merged(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide, high = len(lengths), int(lengths.max())
        place = np.arange(high + 2)[:, None]  # place 0 and those after a part's end hold no symbol
        inside = (place >= 1) & (place <= lengths)
        s = np.where(inside, symbols[np.minimum(starts + np.maximum(place - 1, 0), len(symbols) - 1)], self.NONE)
        after = np.repeat(np.arange(1, high + 3), wide)
        before = np.repeat(np.arange(-1, high + 1), wide)
        best = np.full(s.shape, self.NEVER)
        for k in range(1, high):
            found = self.find(s[k], s[k + 1])
            best[k] = np.where(found == self.NEVER, found, found | k << self.SYMBOL_BITS)
        s, flat = s.ravel(), best.ravel()
        column = np.arange(wide)
        while len(column):
            merge = best.min(axis=0)[column]
            on = merge != self.NEVER
            column, merge = column[on], merge[on]
            piece = merge & ((1 << self.SYMBOL_BITS) - 1)
            here = (merge >> self.SYMBOL_BITS) & ((1 << self.PLACE_BITS) - 1)
            a = here * wide + column
            b = after[a] * wide + column
            beyond, prior = after[b], before[a]
            c, z = beyond * wide + column, prior * wide + column
            s[a], s[b] = piece, self.NONE
            flat[b] = self.NEVER
            after[a], before[c] = beyond, here
            for at, where, left, right in ((a, here, piece, s[c]), (z, prior, s[z], piece)):
                found = self.find(left, right)
                flat[at] = np.where(found == self.NEVER, found, found | where << self.SYMBOL_BITS)
        s = s.reshape(best.shape).T
        kept = s != self.NONE
        return s[kept], kept.sum(axis=1)


class MergeCodec:
    """Encoder and decoder over the vocabulary of a merge-type model file."""

    def __init__(self, model_path: str, end: bool = True):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = end
        self.end_id = model.eos_id()
        self.unknown_id = model.unk_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.text: list[str] = []
        self.byte_of: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.text.append("")
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append("")
            else:
                self.text.append(piece)
                self.score[piece] = model.get_score(i)
                self.ids[piece] = i
                automaton.add_word(piece, (len(piece), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.chars = np.array([len(x) for x in self.text])
        inside = set().union(*map(set, self.ids)) if self.ids else set()
        self.cut_lines = "\n" not in inside
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the space mark inside; parts can't be cut at spaces")
        self.fits: dict[tuple[int, int], bool] = {}
        self.stray: dict[str, int] = {}  # characters without a piece get ids past the vocabulary while encoding
        self.stray_text: list[str] = []
        self.marked = _Parts(self, MARK)
        self.plain = _Parts(self, "")
        self.merges = _Merges(self.ids, self.score)
        self.known = _Known([self.end_id] if end else [])
        decoded = [b"" if i in self.byte_of else x.replace(MARK, " ").encode() for i, x in enumerate(self.text)]
        beside = np.zeros((256, 256), np.bool_)
        for piece in decoded:
            at = np.frombuffer(piece, np.uint8)
            beside[at[:-1], at[1:]] = True
        beside[:, 0x80:0xC0] = True  # not within a character
        beside[ord(" "), ord(" ")] = True
        self.cuts = ~beside.ravel()
        for i, b in self.byte_of.items():
            decoded[i] = bytes([b])
        decoded[self.unknown_id] = " ⁇ ".encode()
        self.piece_bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.piece_width = np.array([len(x) for x in decoded])
        self.piece_first = np.cumsum(self.piece_width) - self.piece_width

    def merged(self, text: str) -> list[str]:
        """Greedy merging from single characters; used on two tokens at a time, so short."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.text[token] if token < len(self.text) else self.stray_text[token - len(self.text)]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            if left < 0:
                known = self.merged(self._text(right)) == [self._text(right)]
            else:
                a, b = self._text(left), self._text(right)
                known = self.merged(a + b) == [a, b]
            self.fits[key] = known
        return known

    def tokens(self, part: str) -> list[int]:
        """Token ids of one part; characters without a piece are numbered past the vocabulary."""
        n = len(part)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for stop, found in self.automaton.iter(part):
            starts[stop - found[0] + 1].append(found)
        for i, c in enumerate(part):
            if c not in self.ids:
                if c not in self.stray:
                    self.stray[c] = len(self.text) + len(self.stray_text)
                    self.stray_text.append(c)
                starts[i].insert(0, (1, self.stray[c]))
        failed, at, path = 0, 0, []  # failed: bit i is set where no encoding goes on from i
        choice = [len(x) for x in starts]
        compatible = self.compatible
        while at < n:
            last = path[-1][1] if path else -1
            options, k = starts[at], choice[at] - 1
            while k >= 0:
                length, token = options[k]
                if not failed >> (at + length) & 1 and compatible(last, token):
                    break
                k -= 1
            choice[at] = k
            if k < 0:
                if not path:
                    raise ValueError("no encoding")
                failed |= 1 << at
                choice[at] = len(options)
                at -= path.pop()[0]
            else:
                path.append((length, token))
                at += length
        return [token for _, token in path]

    def part(self, text: str) -> tuple[bytes, str]:
        """Ids of a part as int32 bytes, and what they decode to."""
        out: list[int] = []
        for token in self._long(text) if len(text) > 4096 else self.tokens(text):
            if token < len(self.text):
                out.append(token)
            else:
                out += [self.byte_id.get(b, self.unknown_id) for b in self._text(token).encode()]
        return array("i", out).tobytes(), self.pieces_text(out)

    def _long(self, text: str) -> Iterator[int]:
        """Very long parts: a bitfield of the whole part would make each step linear, so cut where no piece can cross."""
        start = 0
        covered = bytearray(len(text) + 1)
        for stop, (length, _) in self.automaton.iter(text):
            for i in range(stop - length + 2, stop + 1):
                covered[i] = 1
        cuts = [i for i in range(1, len(text)) if not covered[i]]
        for cut in [*cuts, len(text)]:
            if cut == len(text) or cut - start > 1024:
                yield from self.tokens(text[start:cut])
                start = cut

    def pieces_text(self, ids) -> str:
        """The pieces' text in a row: marks become spaces, runs of byte pieces are read as UTF-8 (bad bytes: U+FFFD)."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_from_bytes(bytes(run)))
                run.clear()
            out.append(" ⁇ " if i == self.unknown_id else self.text[i])
        if run:
            out.append(_from_bytes(bytes(run)))
        return "".join(out).replace(MARK, " ")

    def prepare(self, texts: list[str]) -> None:
        """Puts the short parts of the texts that the caches lack into them."""
        marked: set[str] = set()
        plain: set[str] = set()
        for text in texts:
            if MARK in text:
                text = text.replace(MARK, " ")
            for i, line in enumerate(text.split("\n") if self.cut_lines else [text]):
                words = line.split(" ")
                if "" in words:
                    for cache, word in self._spaced(words, not i):
                        (marked if cache is self.marked else plain).add(word)
                    continue
                if i:
                    plain.add(words[0])
                    del words[0]
                marked.update(words)
        for cache, words in ((self.marked, marked), (self.plain, plain)):
            cache.fill([w for w in words if w not in cache and len(w) <= CACHE_CHARS])

    def _merged_ids(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of short parts: their numbers, their ids end to end, how many each has, and whether some of them are bytes."""
        for numbers, symbols, counts in self.merges(codes, lengths):
            plain = np.flatnonzero(symbols >= self.merges.PLAIN)
            spelt = np.zeros(len(counts), np.bool_)  # parts in which characters without a piece become their bytes
            if len(plain):
                kinds, at = np.unique(symbols[plain], return_inverse=True)
                made = [[self.byte_id.get(b, self.unknown_id) for b in chr(c - self.merges.PLAIN).encode()] for c in kinds.tolist()]
                many = np.ones(len(symbols), np.int64)
                many[plain] = np.array([len(x) for x in made])[at]
                owner = np.repeat(np.arange(len(counts)), counts)
                spelt[owner[plain]] = True
                counts = np.bincount(owner, many, len(counts)).astype(np.int64)
                first = np.cumsum(many) - many
                symbols = np.repeat(symbols, many)
                for k in range(max(map(len, made))):
                    has = many[plain] > k
                    symbols[first[plain[has]] + k] = np.array([x[k] if len(x) > k else 0 for x in made])[at[has]]
            yield numbers, symbols, counts, spelt

    def parts(self, texts: list[str]) -> Iterator[tuple[int, tuple[bytes, str]]]:
        """`part` of many short ones at once, with the number of each."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        for numbers, symbols, counts, spelt in self._merged_ids(codes, np.array([len(x) for x in texts])):
            ids = symbols.astype(np.int32).tobytes()
            text = "".join(map(self.text.__getitem__, symbols.tolist())).replace(MARK, " ")
            ends = np.cumsum(counts)
            chars = np.cumsum(self.chars[symbols])[ends - 1].tolist()
            a = x = 0
            for number, b, y, hard in zip(numbers.tolist(), (4 * ends).tolist(), chars, spelt.tolist(), strict=True):
                own = ids[a:b]
                yield number, (own, self.pieces_text(np.frombuffer(own, np.int32).tolist()) if hard else text[x:y])
                a, x = b, y

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids with the end id, and the decoded text."""
        found: list[tuple[bytes, str]] = []
        if text:
            marked, plain = self.marked, self.plain
            if MARK in text:
                text = text.replace(MARK, " ")
            for i, line in enumerate(text.split("\n") if self.cut_lines else [text]):
                if i:
                    found.append(plain["\n"])
                words = line.split(" ")
                if "" not in words:
                    if i:
                        found.append(plain[words[0]])
                        del words[0]
                    found += [marked[w] for w in words]
                else:
                    found += [cache[w] for cache, w in self._spaced(words, not i)]
        tail = array("i", [self.end_id]).tobytes() if self.end else b""
        if not found:
            return np.frombuffer(tail, dtype=np.int32), ""
        ids, texts = zip(*found, strict=True)
        decoded = "".join(texts)
        return np.frombuffer(b"".join(ids) + tail, dtype=np.int32), decoded[1:] if decoded.startswith(" ") else decoded

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all rows of a string column end to end, how many each has, and what they decode to."""
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        raw, offsets = utf8(column)
        ids, counts, widths, decoded = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
            found = None
            if offsets[stop] - offsets[at] <= GROUP_BYTES:
                found = self._together(raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
            for out, x in zip((ids, counts, widths, decoded), found or self._singly(strings(column[at:stop])), strict=True):
                out.append(x)
            at = stop
        ends = np.concatenate([[0], np.cumsum(np.concatenate(widths))]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(column), pa.py_buffer(ends), pa.py_buffer(b"".join(decoded)))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate(counts), texts

    def _singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        self.prepare(texts)
        ids, decoded = zip(*map(self.encode, texts), strict=True)
        own = [x.encode() for x in decoded]
        return np.concatenate(ids), np.array([len(x) for x in ids]), np.array([len(x) for x in own]), b"".join(own)

    def _together(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes] | None:
        """Ids of rows, how many each has, bytes of each decoded text, and these end to end; none if a part isn't what its hash says."""
        known, total = self.known, len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets))  # empty rows have no parts
        memory = raw.tobytes()
        padded = np.frombuffer(b"".join(b" " + memory[a:b] for a, b in zip(offsets[full].tolist(), offsets[full + 1].tolist(), strict=True)) + bytes(8), np.uint8)
        text, begin = padded[:-8], offsets[full] + np.arange(len(full))
        cut = np.ones(len(text), np.bool_)
        cut[1:] = self.cuts[text[:-1].astype(np.uint16) << 8 | text[1:]]
        cut[begin] = True
        at = np.flatnonzero(cut)
        width = np.diff(at, append=len(text))
        key = _hashes(padded, at, width)
        part = known.table.find(key)
        if (part < 0).any():
            new = np.flatnonzero(part < 0)
            _, first = np.unique(key[new], return_index=True)
            if not known.has_room(len(first)):
                known.clear()
                new = np.arange(len(key))
                _, first = np.unique(key, return_index=True)
            new = new[first]
            self._learn(text, at[new], width[new], key[new])
            part = known.table.find(key)
        if (known.width[part] != width).any():
            return None
        many = np.zeros(total, np.int64)
        many[full] = np.diff(np.searchsorted(at, begin), append=len(at))
        ended = np.zeros(len(at) + total, np.int64)
        ended[np.arange(len(at)) + np.repeat(np.arange(total), many)] = part
        count = known.count[ended]
        ids = _gathered(known.pool, known.first[ended], count)
        decoded = _gathered(self.piece_bytes, self.piece_first[ids], self.piece_width[ids])
        if not np.array_equal(decoded, text):
            return None
        counts = np.diff(np.cumsum(count)[np.cumsum(many + 1) - 1], prepend=0)
        kept = np.ones(len(text), np.bool_)
        kept[begin] = False  # the space that encoding puts first
        return ids, counts, np.diff(offsets), decoded[kept].tobytes()

    def _learn(self, text: np.ndarray, at: np.ndarray, width: np.ndarray, key: np.ndarray) -> None:
        """Puts parts, given by their places in the text, among the known ones."""
        chars = np.diff(np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[np.stack([at, at + width])], axis=0)[0]
        short, long = np.flatnonzero(chars <= CACHE_CHARS), np.flatnonzero(chars > CACHE_CHARS)
        codes = np.frombuffer(_gathered(text, at[short], width[short]).tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.uint32)
        for numbers, ids, count, _ in self._merged_ids(codes, chars[short]):
            chosen = short[numbers]
            self.known.add(key[chosen], width[chosen], count, ids)
        for i in long.tolist():
            ids = np.frombuffer(self.part(text[at[i] : at[i] + width[i]].tobytes().decode().replace(" ", MARK))[0], np.int32)
            self.known.add(key[i : i + 1], width[i : i + 1], np.array([len(ids)]), ids)

    def _spaced(self, words: list[str], first: bool) -> Iterator[tuple[_Parts, str]]:
        """Parts of a line with spaces in a row, each with its cache: each run of marks goes with the word after it."""
        marks = 0
        for k, word in enumerate(words):
            marks += bool(k or first)
            if word or k == len(words) - 1:
                if marks == 1 and word:
                    yield self.marked, word
                elif marks or word:
                    yield self.plain, MARK * marks + word
                marks = 0

    def decode(self, ids) -> str:
        """Text of a whole id sequence; the space that encoding puts first is taken off."""
        text = self.pieces_text(ids)
        first = next((i for i in ids if i in self.byte_of or self.text[i]), None)
        return text[1:] if first is not None and first not in self.byte_of and self.text[first].startswith(MARK) else text


def _from_bytes(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


class _Parts(dict):
    """Bounded cache from part to (ids, text), filled when a part is first asked for."""

    def __init__(self, codec: MergeCodec, prefix: str):
        super().__init__()
        self.codec, self.prefix = codec, prefix

    def __missing__(self, word: str):
        value = self.codec.part(self.prefix + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[word] = value
        return value

    def fill(self, words: list[str]) -> None:
        if len(self) + len(words) > CACHE_PARTS:
            self.clear()
        if words:
            for number, value in self.codec.parts([self.prefix + w for w in words]):
                self[words[number]] = value


_CODECS: dict[tuple[str, bool], MergeCodec] = {}


def codec(model_path: str, end: bool = True) -> MergeCodec:
    """One codec per worker process and model."""
    key = (model_path, end)
    if key not in _CODECS:
        _CODECS[key] = MergeCodec(model_path, end)
    return _CODECS[key]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """Per row: the id column, `ids` array<int> and `decoded` string. A narrow map: no shuffle, one pass over the text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, end)
        for part in slices(batches):
            ids, counts, decoded = own.rows(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), int_lists(ids, counts, pa.int32()), decoded], names=["id", "ids", "decoded"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
