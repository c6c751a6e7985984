"""Token ids of whole batches of texts, with one tokenizer call per distinct word of a worker.

Byte-level BPE never merges across its pre-token boundaries, so the ids of a text are the ids of its pre-tokens in
order.  The boundaries are found for a whole batch at once with array operations over code points; each pre-token is
named by a 64-bit hash, and only names not met before go through the tokenizer.  Texts that hold the string of an added
token are given to the tokenizer as a whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# Unicode White_Space, as the pre-tokenizer's \s: fixed values
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MULTIPLIER = 0x9E3779B97F4A7C15
#: Names kept per worker, and ids of all of them: at most this many; beyond, the table starts anew.
MAX_NAMES, MAX_IDS = 1_500_000, 12_000_000
#: Words given to the tokenizer at a time: it holds some hundred bytes per token of a call beside the ids.
LEARNED = 4_096
#: Longer texts are encoded in parts.
LONG = 2_000_000


def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def starts_of_pretokens(cp: np.ndarray, cls: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Boolean per code point: does a pre-token of the byte-level pattern start here?  ``begins``: where texts start.

    Runs of letters, numbers or other signs take one blank before them along; of a white-space run before such a run
    the last character stands alone (or is that blank); 's 't 'm 'd 're 've 'll stand alone after anything but a blank.
    """
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = cls[1:] != cls[:-1]
    start |= first[:n]
    space = cls == SPACE
    # the last character of a white-space run that another run of the same text follows
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last
    taken = np.zeros(n, bool)  # runs that begin with the blank before them
    taken[1:] = last[:-1] & (cp[:-1] == 32)
    start &= ~taken

    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        at = lambda i: np.where(i < n, cp[np.minimum(i, n - 1)], 0)
        end = np.searchsorted(begins, quote, "right")
        limit = np.append(begins, n)[end]
        a, b = at(quote + 1), at(quote + 2)
        one = (quote + 1 < limit) & np.isin(a, [ord(c) for c in "stmd"])
        two = (quote + 2 < limit) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for found, size in ((one, 2), (two, 3)):
            q = quote[found]
            start[q + 1] = False
            if size == 3:
                start[q + 2] = False
            after = q + size
            start[after[after < n]] = True
    return start


class WordTokenizer:
    """Ids of texts under a byte-level BPE file; see the module's text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = class_table()
        rng = np.random.default_rng(20)
        self.mix = rng.integers(0, 2**64, 0x110000, np.uint64, endpoint=False)
        self.power = self.inverse = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.names = np.empty(0, np.uint64)  # sorted
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int32)  # of each name in ids
        self.ids, self.n_ids = np.empty(0, np.uint32), 0  # with room at the end

    def powers(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << n.bit_length()
            step = np.full(size, MULTIPLIER, np.uint64)
            step[0] = 1
            back = np.full(size, pow(MULTIPLIER, -1, 2**64), np.uint64)
            back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def learn(self, names: np.ndarray, words: list[str]) -> None:
        """Tokenize words not met before, whose names ascend, and add them to the table."""
        if len(self.names) + len(names) > MAX_NAMES or self.n_ids > MAX_IDS:
            self.clear()
        ids, sizes = [], []
        for at in range(0, len(words), LEARNED):
            some = words[at : at + LEARNED]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(some)))
            ids.append(np.asarray(got.ids, np.uint32))
        sizes = np.concatenate(sizes)
        stops = self.n_ids + np.cumsum(sizes)
        if stops[-1] > len(self.ids):
            more = np.empty(int(stops[-1]) * 5 // 4, np.uint32)
            more[: self.n_ids] = self.ids[: self.n_ids]
            self.ids = more
        self.ids[self.n_ids : stops[-1]] = np.concatenate(ids)
        self.n_ids = int(stops[-1])
        # both sides are sorted
        spot = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, spot, names)
        self.begin, self.size = np.insert(self.begin, spot, stops - sizes), np.insert(self.size, spot, sizes)

    def _encode_long(self, text: str) -> np.ndarray:
        """Cut where a blank or line feed follows something else: a pre-token always starts there."""
        if any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        cut, parts, at = re.compile(r"(?<=\S)[ \n]"), [], 0
        while at < len(text):
            found = cut.search(text, at + LONG // 2)
            to = found.start() if found else len(text)
            piece = text[at:to]
            parts.append(self._encode_batch([piece])[0])
            at = to
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if any(len(t) > LONG for t in texts):
            parts = [self._encode_long(t) if len(t) > LONG else self.encode([t])[0] for t in texts]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if whole:
            plain_ids, plain_sizes = self.encode([t for i, t in enumerate(texts) if i not in whole])
            cuts = iter(np.split(plain_ids, np.cumsum(plain_sizes)[:-1]) if len(plain_sizes) else [])
            parts = [np.asarray(whole[i], np.uint32) if i in whole else next(cuts) for i in range(len(texts))]
            return np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        return self._encode_batch(texts)

    def _encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = int(lengths.sum())
        if n == 0:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        begins = np.unique((ends - lengths)[lengths > 0])
        at = np.flatnonzero(starts_of_pretokens(cp, self.classes[cp], begins))
        self.powers(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.mix[cp] * self.power[:n], out=sums[1:])
        to = np.append(at[1:], n)
        names = (sums[to] - sums[at]) * self.inverse[at]
        uniq, one, back = np.unique(names, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.names, uniq)
        known = np.zeros(len(uniq), bool)
        inside = spot < len(self.names)
        known[inside] = self.names[spot[inside]] == uniq[inside]
        if not known.all():
            if len(self.names) + (~known).sum() > MAX_NAMES or self.n_ids > MAX_IDS:
                self.clear()
                known[:] = False
            new = one[~known]
            self.learn(uniq[~known], [joined[a:b] for a, b in zip(at[new].tolist(), to[new].tolist())])
            spot = np.searchsorted(self.names, uniq)
        sizes = self.size[spot][back].astype(np.int64)
        total = np.cumsum(sizes)
        source = np.repeat(self.begin[spot][back] - (total - sizes), sizes) + np.arange(total[-1])
        before = np.append(0, total)[np.searchsorted(at, np.append(ends - lengths, n))]
        return self.ids[source], np.diff(before)
