"""Byte-level BPE of many texts at once, with the ids of the ``tokenizers`` library.

The library splits a text into words before BPE and encodes each word by itself, so a word seen
before need not be encoded again. Here the split is one vectorised pass over the code points of a
whole batch, words are looked up by a hash and compared with the word found, code point by code
point, and only words not seen yet go through the library. Character classes are asked of the
library's own splitter.
"""

from __future__ import annotations

import numpy as np

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_BLOCK = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
#: Words held at once and their code points, and code points of one vectorised pass.
MAX_WORDS = 400_000
MAX_HELD = 1 << 22
PASS_CHARS = 1 << 18
_SLOT_BITS = 20


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others, in order, for the code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class BatchEncoder:
    """Encodes texts with the tokenizer of a ``tokenizers`` JSON file with byte-level splitting."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.longest_special = max(map(len, self.specials), default=0)
        self.char_of_byte = _byte_characters()
        self.classes = np.full(0x110000, 255, np.uint8)
        self.blocks: set[int] = set()
        size = PASS_CHARS + 1
        self.power = np.cumprod(np.full(size, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(size, _INVERSE, np.uint64))
        self._forget()

    def _forget(self) -> None:
        #: Hashes of words (0: none) and their numbers, in the first free slot from the hash's own on; and
        #: numbers of words whose hash another word has.
        self.slot_key = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.slot_word = np.zeros(1 << _SLOT_BITS, np.int32)
        self.same_hash: dict[str, int] = {}
        self.known = 0
        #: Of each word: tokens and the first one's place in flat, code points and the first one's place in held.
        self.count, self.first, self.size, self.place = (np.zeros(1 << 14, np.int32) for _ in range(4))
        self.flat = np.zeros(1 << 16, np.uint32)
        self.held = np.zeros(1 << 18, np.uint32)
        self.used = self.held_used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words of hashes ``h``, -1 for unknown ones."""
        word = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(todo):
            key = self.slot_key[slot]
            hit = key == h[todo]
            word[todo[hit]] = self.slot_word[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return word

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Different hashes, unknown so far."""
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(h):
            free = self.slot_key[slot] == 0
            self.slot_key[slot[free]] = h[free]
            own = self.slot_key[slot] == h  # of several that want a slot, one has it
            self.slot_word[slot[own]] = number[own]
            h, number, slot = h[~own], number[~own], (slot[~own] + 1) & ((1 << _SLOT_BITS) - 1)

    def _full(self) -> bool:
        return self.known > MAX_WORDS or self.held_used > MAX_HELD

    def _class_of(self, cp: np.ndarray) -> np.ndarray:
        for block in np.flatnonzero(np.bincount(cp >> 12, minlength=1)):
            if block not in self.blocks:
                self.blocks.add(int(block))
                pieces = self.library.pre_tokenizer.pre_tokenize_str
                for c in range(block * _BLOCK, min(0x110000, (block + 1) * _BLOCK)):
                    if not 0xD800 <= c < 0xE000:
                        own = [len(pieces(seed + chr(c))) == 1 for seed in "a1!"]
                        self.classes[c] = own.index(True) if any(own) else _SPACE
        return self.classes[cp]

    def _split(self, cp: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Starts of the words of segments that start at ``heads``, as the library splits them."""
        n = len(cp)
        kind = self._class_of(cp)
        head = np.zeros(n + 1, bool)
        head[heads] = True
        head[n] = True
        start = head.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last of a run of spaces, if text follows in the segment: a plain space joins that text
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:n])
        start[last] = True
        start[last[cp[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll where the apostrophe stands alone before letters
        mark = np.flatnonzero((cp == 39) & start[:n])
        mark = mark[(mark + 1 < n)]
        mark = mark[start[mark + 1] & ~head[mark + 1] & (kind[mark + 1] == _LETTER)]
        if len(mark):
            one = cp[mark + 1]
            two = cp[np.minimum(mark + 2, n - 1)]
            there = (mark + 2 < n) & ~head[np.minimum(mark + 2, n)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = there & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for at, width in ((mark[short], 2), (mark[long], 3)):
                start[at + 1] = False
                rest = at + width
                rest = rest[rest < n]
                rest = rest[~head[rest] & (kind[rest] == _LETTER)]
                start[rest] = True
        return np.flatnonzero(start[:n])

    def _words(self, text: str, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words of ``text`` and their numbers in the table."""
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        starts = self._split(cp, heads)
        ends = np.append(starts[1:], len(cp))
        length = ends - starts
        h = np.add.reduceat((cp.astype(np.uint64) + np.uint64(1)) * self.power[: len(cp)], starts) * self.inverse[starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + length.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        word = self._find(h)
        miss = np.flatnonzero(word < 0)
        if len(miss):
            keys, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            own = miss[at]
            number = self._learn([text[b:e] for b, e in zip(starts[own].tolist(), ends[own].tolist())])
            self._put(keys, number)
            word[miss] = number[back]
        for i in self._unlike(cp, starts, length, word).tolist():
            own = text[starts[i] : ends[i]]
            if own not in self.same_hash:
                self.same_hash[own] = int(self._learn([own])[0])
            word[i] = self.same_hash[own]
        return starts, word

    def _unlike(self, cp: np.ndarray, starts: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which words differ from the word of the table that their hash led to."""
        same_size = self.size[word] == length
        # a word of another size is compared with whatever is held there, within bounds
        at = np.repeat(self.place[word].astype(np.int64) - starts, length) + np.arange(len(cp))
        equal = self.held[np.minimum(at, len(self.held) - 1)] == cp
        return np.flatnonzero(~(same_size & np.logical_and.reduceat(equal, starts)))

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of new words."""
        merge, char = self.library.model.tokenize, self.char_of_byte
        ids = [[t.id for t in merge("".join(map(char.__getitem__, w.encode())))] for w in words]
        number = np.arange(self.known, self.known + len(words))
        self.known += len(words)
        tokens, chars = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, words))
        while self.known > len(self.count):
            self.count, self.first, self.size, self.place = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.first, self.size, self.place))
        while self.used + tokens.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held_used + chars.sum() > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.count[number], self.size[number] = tokens, chars
        self.first[number] = self.used + np.cumsum(tokens) - tokens
        self.place[number] = self.held_used + np.cumsum(chars) - chars
        self.flat[self.used : self.used + tokens.sum()] = np.fromiter((i for x in ids for i in x), np.uint32, tokens.sum())
        self.held[self.held_used : self.held_used + chars.sum()] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.used += int(tokens.sum())
        self.held_used += int(chars.sum())
        return number

    def _ids(self, word: np.ndarray) -> np.ndarray:
        size = self.count[word].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[word] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one text of at most PASS_CHARS code points: word starts, tokens of each word, ids.

        A special string in the text is a word of one token, as by the library's default.
        """
        starts, sizes, ids, at = [], [], [], 0
        for part, special in self._segments(text):
            if special is not None:
                starts.append(np.array([at])), sizes.append(np.array([1])), ids.append(np.array([special], np.uint32))
            elif part:
                if self._full():
                    self._forget()
                s, w = self._words(part, np.array([0]))
                starts.append(s + at), sizes.append(self.count[w]), ids.append(self._ids(w))
            at += len(part)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)

    def _segments(self, text: str):
        if not any(s in text for s in self.specials):
            return [(text, None)]
        out, at = [], 0
        while True:
            found = [(i, -len(s), s) for s in self.specials if (i := text.find(s, at)) >= 0]
            if not found:
                out.append((text[at:], None))
                return out
            i, _, s = min(found)
            out += [(text[at:i], None), (s, self.specials[s])]
            at = i + len(s)

    def encode(self, texts: list[str], with_ids: bool = True):
        """Token counts of all texts, and their ids one after the other (None without ``with_ids``).

        Texts are passed in groups of PASS_CHARS code points; longer ones are spliced from
        overlapping chunks.
        """
        counts = np.zeros(len(texts), np.int64)
        ids: list[np.ndarray] = []
        group: list[int] = []
        size = 0

        def flush():
            nonlocal group, size
            if not group:
                return
            if self._full():
                self._forget()
            own = [texts[i] for i in group]
            heads = np.cumsum([0] + [len(t) for t in own])
            starts, word = self._words("".join(own), heads[:-1])
            n = self.count[word].astype(np.int64)
            counts[group] = np.add.reduceat(n, np.searchsorted(starts, heads[:-1]))
            if with_ids:
                ids.append(self._ids(word))
            group, size = [], 0

        for i, text in enumerate(texts):
            if len(text) > CHUNK or any(s in text for s in self.specials):
                flush()
                own = [x for x in spliced(self, text)]
                counts[i] = sum(n for n, _ in own)
                if with_ids:
                    ids += [x for _, x in own]
            elif text:
                if size + len(text) > PASS_CHARS // 2:
                    flush()
                group.append(i)
                size += len(text)
        flush()
        return counts, (np.concatenate(ids) if ids else np.zeros(0, np.uint32)) if with_ids else None


#: Code points of one chunk of a huge document and of its overlap with the next.
CHUNK = 1 << 16
OVERLAP = 1 << 9


def spliced(encoder: BatchEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Yields (count, ids) of consecutive parts of ``text``, together those of the whole text.

    The text is encoded in chunks that overlap, and two chunks are spliced where both start a word.
    Such a place is proven: how a text splits from a word start on depends on what follows only, and
    the earlier chunk, itself right from its splice on, saw more after the place than a word end or a
    special string needs. Where the overlap holds no such place (a run of one class longer than the
    overlap), the earlier chunk is widened and encoded again, at last to the end of the text.
    """
    margin = encoder.longest_special + 4
    least, lap_least = max(chunk, 4 * margin), max(overlap, 2 * margin)
    begin, splice, width, lap = 0, 0, least, lap_least
    own = encoded(encoder, text[:width])
    while True:
        end = min(len(text), begin + width)
        starts, sizes, ids = own
        starts = starts + begin
        first = np.searchsorted(starts, splice)
        skip = int(sizes[:first].sum())
        if end == len(text):
            yield int(sizes[first:].sum()), ids[skip:]
            return
        nxt = max(splice + 1, end - lap)
        after = encoded(encoder, text[nxt : min(len(text), nxt + least)])
        common = np.intersect1d(starts[first:], after[0] + nxt)
        common = common[(common > splice) & (common <= end - margin)]
        if not len(common):
            width, lap = 2 * width, 2 * lap
            own = encoded(encoder, text[begin : min(len(text), begin + width)])
            continue
        place = int(common[-1])
        last = np.searchsorted(starts, place)
        taken = int(sizes[first:last].sum())
        yield taken, ids[skip : skip + taken]
        splice, begin, own = place, nxt, after
        width, lap = least, lap_least


def encoded(encoder: BatchEncoder, text: str):
    """Word starts, tokens of each word and ids of a chunk; one over PASS_CHARS goes to the library whole."""
    if len(text) <= PASS_CHARS:
        return encoder.words(text)
    e = encoder.library.encode(text, add_special_tokens=False)
    spans = encoder.library.pre_tokenizer.pre_tokenize_str(text) if not any(s in text for s in encoder.specials) else None
    if spans is None:  # no word starts are known here, so only the end of the text can follow
        return np.array([0]), np.array([len(e.ids)]), np.array(e.ids, np.uint32)
    starts = np.array([s for _, (s, _) in spans])
    words = np.array([w for w in e.word_ids], np.int64)
    return starts, np.bincount(words, minlength=len(starts)), np.array(e.ids, np.uint32)


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
