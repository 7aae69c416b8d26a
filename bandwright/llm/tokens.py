"""Token ids of whole texts, computed word by word with the tokenizers library.

Where a vocabulary's pre-tokenizer never joins characters across ASCII white space, a text's ids are those of its words in
order; a probe at the start decides, and other vocabularies take whole texts. Words repeat: each Python worker keeps the ids
of the words seen last, within a bound, the older ones of them as arrays, and hands the others to the library many at a time. Words of letters with trailing punctuation are cut into pre-tokens here, as the vocabulary's
pre-tokenizer would, and go to its BPE model straight away; any other word takes the whole tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Punctuation of which a run may end a word of letters on the direct way. No apostrophe: the vocabulary treats it apart.
ENDS = b".,;:!?#$%&*|+=-"
LATIN = frozenset("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß")
#: How special tokens start.
SPECIAL = b"<|"
#: Words that are looked up together, and those handed to the library at once.
TOGETHER, AT_ONCE = 16_384, 512


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte, by Latin-1 code point."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Shelf:
    """A generation of words and their ids as arrays, which is only looked up: some 45 bytes a word, where a dict takes 160."""

    def __init__(self, known: dict[bytes, bytes]):
        hashes = np.fromiter(map(hash, known), np.int64, len(known))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.words, self.word_at = self.joined(list(known), order)
        self.ids, self.id_at = self.joined(list(known.values()), order)

    @staticmethod
    def joined(parts: list[bytes], order: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The parts in order, and where each starts, and the last ends."""
        starts = np.zeros(len(parts) + 1, np.uint32)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))[order], out=starts[1:])
        return b"".join(map(parts.__getitem__, order.tolist())), starts

    def find(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, its ids) of the words that are here. A word whose hash an earlier one has may be missed."""
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[at] == hashes)
        at = at[met]
        places = (self.word_at[at], self.word_at[at + 1], self.id_at[at], self.id_at[at + 1])
        for i, a, b, c, d in zip(met.tolist(), *(x.tolist() for x in places), strict=True):
            if self.words[a:b] == words[i]:
                yield words[i], self.ids[c:d]


class WordTokenizer:
    """encode() gives a text's ids as little-endian 32-bit numbers. Generations of LIMIT words are kept: one at hand, SHELVES as arrays."""

    LIMIT, SHELVES = 400_000, 1

    def __init__(self, path: str, kept: tuple[int, int] | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        if kept:
            self.LIMIT, self.SHELVES = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {k: v for k, v in byte_alphabet().items() if k != 0x20}
        self.young: dict[bytes, bytes] = {}
        self.shelves: list[Shelf] = []
        self.ends: dict[bytes, bytes] = {}
        self.direct = False
        probe = [w.encode() for w in ("the", "Élève", "straße,", "ÖL.", "Mañana!", "a", "Œuvre", "x1", "stop!!", "##$$", "a+=-")]
        whole = [self.whole(w) for w in probe]
        self.direct = True
        mixed = b"The  quick\n\nbrown \t fox's 12 jumps,\r\nover \xc3\x89t\xc3\xa9 -- a.b \n x  "
        capitals = b" ".join(bytes([c, c, c + 32]) for c in range(ord("A"), ord("Z") + 1)) + b" " + mixed
        #: whether the vocabulary ignores the case of A-Z, so that texts may be lower-cased before words are looked up
        self.folds = self.whole(capitals) == self.whole(capitals.lower())
        self.direct = self.folds and self.fresh(probe) == whole
        #: whether a text's ids are its words' ids
        self.by_word = self.whole(mixed) == b"".join(map(self.whole, mixed.split()))

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, word: bytes) -> tuple[str, ...] | None:
        """The pre-tokens of a simple word, lower-cased; None for others."""
        body = word.rstrip(ENDS)
        end = word[len(body) :]
        if not body:
            return (end.decode(),)
        if not body.isalpha():
            text = body.decode().lower()
            if not text or not LATIN.issuperset(text):
                return None
            body = text.encode()
        return (body.lower().decode("latin-1"), end.decode()) if end else (body.lower().decode("latin-1"),)

    def fresh(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that are not at hand."""
        out: list[bytes | None] = [None] * len(words)
        places, tails, pieces = [], [], []
        for i, w in enumerate(words):
            cut = self.cut(w) if self.direct else None
            if cut is None:
                out[i] = self.whole(w)
            else:
                places.append(i)
                pieces.append(cut[0])
                tails.append(self.end(cut[1].encode()) if len(cut) > 1 else b"")
        if places:
            found = self.pieces.encode(" ".join(pieces).translate(self.letters), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            starts = (np.searchsorted(np.array(found.word_ids), np.arange(len(pieces) + 1)) * 4).tolist()
            for k, i in enumerate(places):
                out[i] = ids[starts[k] : starts[k + 1]] + tails[k]
        return out

    def end(self, run: bytes) -> bytes:
        """The ids of a run of punctuation."""
        found = self.ends.get(run)
        if found is None:
            if len(self.ends) >= AT_ONCE:
                self.ends.clear()
            found = self.ends[run] = self.fresh([run])[0]
        return found

    def shelved(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of those words that are on a shelf; words keeps the others."""
        found: dict[bytes, bytes] = {}
        for shelf in self.shelves:
            here = dict(shelf.find(list(words)))
            words.difference_update(here)
            found |= here
        return found

    def learn(self, words: Iterable[bytes]) -> None:
        young = self.young
        new = set(words).difference(young)
        young.update(self.shelved(new))
        bodies = {}
        if self.direct:
            for w in new:
                body = w.rstrip(ENDS)
                if len(body) < len(w) and body.isalpha():
                    bodies[w] = body
        known = self.shelved(set(bodies.values()).difference(young))
        for w, body in bodies.items():
            if ids := young.get(body) or known.get(body):
                young[w] = ids + self.end(w[len(body) :])
                new.discard(w)
        missing = list(new)
        for i in range(0, len(missing), AT_ONCE):
            part = missing[i : i + AT_ONCE]
            self.young.update(zip(part, self.fresh(part), strict=True))

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each UTF-8 text, as many texts at a time as hold some TOGETHER words."""
        if not self.by_word:
            yield from map(self.whole, texts)
            return
        pending: list[list[bytes]] = []
        size = 0
        for text in texts:
            if self.folds and SPECIAL not in text:  # special tokens keep their case
                text = text.lower()
            pending.append(words := text.split())
            size += len(words)
            if size >= TOGETHER:
                yield from self.joined(pending)
                pending, size = [], 0
        yield from self.joined(pending)

    def joined(self, pending: list[list[bytes]]) -> Iterator[bytes]:
        if len(self.young) >= self.LIMIT:
            self.shelves = [Shelf(self.young), *self.shelves[: self.SHELVES - 1]]
            self.young = {}
        self.learn(chain.from_iterable(pending))
        for words in pending:
            yield b"".join(map(self.young.__getitem__, words))


#: LIMIT and SHELVES where other steps share the workers: less memory, more time.
FEW = 150_000, 3
_ready: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, kept: tuple[int, int] | None = None) -> WordTokenizer:
    """One for each worker, vocabulary file and bound on the words kept."""
    if (path, kept) not in _ready:
        _ready[path, kept] = WordTokenizer(path, kept)
    return _ready[path, kept]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_size(path: str) -> int:
    return tokenizer(path).tokenizer.get_vocab_size()
