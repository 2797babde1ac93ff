"""Token ids from the files of public tokenizers, each distinct piece of text encoded once per worker.

A piece is a run of ASCII white space with the characters behind it. Both kinds of vocabulary treat
pieces apart: the byte-level pattern never matches across a character and the white space behind it,
and no entry of the other vocabulary holds white space behind another character (looked up when the
file is loaded). Texts with other white space, with the sign that stands for a space, or with a
special token that is to be recognised, and vocabularies for which this does not hold, are given to
the library whole. Results are those of the library for the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

PIECE = re.compile(r"[ \t\n\v\f]+[^ \t\n\v\f]*|[^ \t\n\v\f]+")
# Other white space (a carriage return among it), and the sign for a space: such texts are not cut.
UNCUT = re.compile(r"[^\S \t\n\v\f]|[\u180e\u2581]")
SPACE = "▁"
# Pieces and their characters that one worker remembers; beyond either the memory starts anew.
REMEMBERED = 700_000
REMEMBERED_CHARS = 32_000_000


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next beyond 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Slots(dict):
    """Pieces with their slots; a piece that is met for the first time gets the next one and is noted in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = len(self)
        self.fresh.append(piece)
        return slot


class PieceMemory:
    """Ids of pieces by one or more encoders, each piece encoded once.

    ``known`` maps a piece to its slot; ``flat[start:start + length]`` are the ids of a slot. With the bytes
    of the tokens, ``spelt`` says whether all encoders' tokens of a slot join to the piece.
    """

    def __init__(self, encoders: Sequence[Callable[[list[str]], list[list[int]]]], token_bytes: Sequence[list[bytes]] = ()):
        self.encoders, self.token_bytes = encoders, token_bytes
        self.forget()

    def forget(self) -> None:
        self.known = Slots()
        self.flat = [np.zeros(0, np.int32) for _ in self.encoders]
        self.start = [np.zeros(0, np.int64) for _ in self.encoders]
        self.length = [np.zeros(0, np.int64) for _ in self.encoders]
        self.spelt = np.zeros(0, bool)
        self.chars = 0

    def learn(self) -> None:
        """Encode the pieces that were met for the first time."""
        new, self.known.fresh = self.known.fresh, []
        if not new:
            return
        right = np.ones(len(new), bool)
        for k, encode in enumerate(self.encoders):
            ids = encode(new)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start[k] = np.concatenate((self.start[k], len(self.flat[k]) + np.cumsum(lengths) - lengths))
            self.length[k] = np.concatenate((self.length[k], lengths))
            self.flat[k] = np.concatenate((self.flat[k], np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))))
            if self.token_bytes:
                spell = self.token_bytes[k].__getitem__
                right &= np.fromiter((b"".join(map(spell, i)) == p.encode() for i, p in zip(ids, new)), bool, len(new))
        self.spelt = np.concatenate((self.spelt, right))
        self.chars += sum(map(len, new))

    def slots(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Slots of the pieces of each text; None stays None."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        get, found = self.known.__getitem__, []
        for text in texts:
            pieces = None if text is None else PIECE.findall(text)
            found.append(None if pieces is None else np.fromiter(map(get, pieces), np.int64, len(pieces)))
        self.learn()
        return found

    def ids(self, slots: np.ndarray, k: int = 0) -> np.ndarray:
        n = self.length[k][slots]
        before = np.cumsum(n) - n
        return self.flat[k][np.repeat(self.start[k][slots] - before, n) + np.arange(n.sum())]


class Vocabulary:
    """Ids of texts. Subclasses say how the library encodes a list of texts and which texts may be cut."""

    def __init__(self):
        self.memory = PieceMemory([self.encode_pieces])

    def whole(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return self.whole(pieces)

    def keeps_whole(self, text: str) -> bool:
        """Whether pieces of this text could differ from the whole, apart from its white space."""
        return False

    def may_cut(self, text: str) -> bool:
        return not self.keeps_whole(text) and not UNCUT.search(text)

    def pieces_of(self, text: str) -> str:
        """The text that the pieces are cut from."""
        return text

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        slots = self.memory.slots([self.pieces_of(t) if self.may_cut(t) else None for t in texts])
        return [np.array(self.whole([t])[0], np.int32) if s is None else self.memory.ids(s) for t, s in zip(texts, slots)]

    def counts(self, texts: list[str]) -> list[int]:
        slots = self.memory.slots([self.pieces_of(t) if self.may_cut(t) else None for t in texts])
        return [len(self.whole([t])[0]) if s is None else int(self.memory.length[0][s].sum()) for t, s in zip(texts, slots)]


class ByteVocabulary(Vocabulary):
    """A ``.json`` file of the tokenizers library. ``special_as_text``: special tokens' strings are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        # A task has one core, and threads do not outlive the fork of a worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        self.apart = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        added = parts["added_tokens"]
        self.marks = [t["content"] for t in added if not (special_as_text and t["special"])]
        super().__init__()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keeps_whole(self, text: str) -> bool:
        return not self.apart or any(m in text for m in self.marks)

    def token_bytes(self) -> list[bytes]:
        signs = byte_signs()
        entries = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        return entries


class PieceVocabulary(Vocabulary):
    """A ``.model`` file of the sentencepiece library, which puts a space in front of each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = re.compile(rf"[^{SPACE} \t\n\v\f][{SPACE} \t\n\v\f]|{SPACE}[ \t\n\v\f]|[ \t\n\v\f]{SPACE}")
        self.space = self.model.piece_to_id(SPACE)
        # One space, a word and two lines show whether texts are kept as they are.
        probe = "a  b\n\nc "
        self.apart = (not any(inner.search(n) for n in self.names) and self.names[self.space] == SPACE
                      and b"".join(map(self.token_bytes().__getitem__, self.whole([probe])[0])) == b" " + probe.encode())
        super().__init__()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def keeps_whole(self, text: str) -> bool:
        return not self.apart

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """A piece that starts with a space gives it to the library to put there again; else the added one is taken off.

        Nothing is put in front of an empty text.
        """
        spaced = [p[1:] if p[0] == " " else p for p in pieces]
        return [[self.space] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, self.whole(spaced))]

    def pieces_of(self, text: str) -> str:
        return " " + text if text else ""

    def token_bytes(self) -> list[bytes]:
        """A piece in UTF-8 with its sign for a space as a space; byte entries as their byte."""
        return [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]


_loaded: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, special_as_text: bool = False) -> Vocabulary:
    """The vocabulary of a file by its ending, loaded once per worker."""
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded[key] = ByteVocabulary(path, special_as_text) if path.endswith(".json") else PieceVocabulary(path)
    return _loaded[key]


def version_digest(path: str) -> str:
    """Hex digest of all that decides a count: the file, the library and its version."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    version = __import__(library).__version__
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library} {version}\n".encode() + hashlib.sha256(file.read()).digest()).hexdigest()
