"""The tokenizers library over Arrow text: a string is encoded once for each distinct run that the tokenizer treats alone.

A tokenizer's pre-splitting never joins what a plain space parts (given the conditions below), so a text's ids are those of
its parts one after another, and a part that was seen before is looked up.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array

#: Parts that a worker remembers; then it starts anew. About 170 bytes each.
MEMORY = 600_000


def byte_table() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others for the characters from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0
    for b in range(256):
        out.append(chr(b if b in own else 256 + more))
        more += b not in own
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merge into token, by applying the merges of lower rank."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min(((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1)))
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def byte_bpe(path: str, pattern: str) -> str:
    """A rank file as a tokenizer of the library, serialised: split by the pattern, bytes as characters, merges by rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_table()
    shown = {t: "".join(table[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (pair := last_merge(token, ranks)):
            merges.append((shown[pair[0]], shown[pair[1]]))
    tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


def byte_values(tokenizer) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    back = {c: b for b, c in enumerate(byte_table())}
    return {i: bytes(back[c] for c in token) for token, i in tokenizer.get_vocab().items() if all(c in back for c in token)}


def load(serialised: str):
    """One thread a worker: tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(serialised)
    out.encode_special_tokens = True  # their strings in a text are ordinary text
    return out


#: White space beside a space: there a pattern with a leading space may split otherwise, and the text is encoded whole.
BESIDE = re.compile(r"\s | \s|\0")


class Spaced:
    """Parts that begin with the space before them; for patterns in which a space goes to the word after it.

    A part is named without its space, and the first of a text, which has none, with a NUL.
    """

    fold = False

    @staticmethod
    def parts(text: str) -> list[str] | None:
        if BESIDE.search(text):
            return None
        out = text.split(" ")
        out[0] = "\0" + out[0]
        return out

    @staticmethod
    def real(part: str) -> str:
        return part[1:] if part[:1] == "\0" else " " + part


class Bare:
    """Parts without white space around them; for tokenizers that drop it and the case of letters."""

    fold = True

    @staticmethod
    def parts(text: str) -> list[str] | None:
        return text.replace("\n", " ").split(" ")

    @staticmethod
    def real(part: str) -> str:
        return part


#: Words of letters below this one are one run for every pattern here, have one form, and change case letter by letter: the
#: model's merges alone give their ids, without the library's splitting.
LETTERS = "\u0130"


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer whose alphabet is bytes."""

    def __init__(self, serialised: str, kind, memory: int = MEMORY):
        self.tokenizer, self.kind, self.memory, self.known = load(serialised), kind, memory, {}
        self.table = byte_table()
        self.lead = "" if kind.fold else self.table[0x20]
        self.tails = dict(zip(",.", self.encoded([",", "."]), strict=True))

    def encoded(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 20_000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        return out

    def word(self, core: str) -> bytes:
        """Ids of letters below LETTERS, by the model's merges alone."""
        shown = core if core.isascii() else "".join([self.table[b] for b in core.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(self.lead + shown)]).tobytes()

    def learn(self, new: set[str]) -> None:
        """A comma or full stop after a letter is a token of its own, so that most parts are a word seen before."""
        known, tails, fold, rest = self.known, self.tails, self.kind.fold, []
        for part in new:
            core, tail = part, None
            if not part.isalpha():
                core, tail = part[:-1], part[-1:]
                if tail not in tails or not core.isalpha():
                    rest.append(part)
                    continue
            if not core.isascii() and max(core) >= LETTERS:
                rest.append(part)
                continue
            if fold:
                core = core.lower()
            ids = known.get(core)
            if ids is None:
                ids = known[core] = self.word(core)
            if tail:
                known[part] = ids + tails[tail]
            elif part is not core:
                known[part] = ids
        known.update(zip(rest, self.encoded([self.kind.real(x) for x in rest]), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.memory:
            self.known = {}
        parts = [self.kind.parts(text) for text in texts]
        if new := set().union(*(p for p in parts if p is not None)).difference(self.known):
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) if p is not None else self.encoded([text])[0] for p, text in zip(parts, texts, strict=True)]

    def forget(self) -> None:
        """What was remembered goes, before the worker serves another operator."""
        self.known = {}

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


_encoders: dict = {}


def encoder(serialised: str, kind, memory: int = MEMORY) -> Encoder:
    """A worker's one encoder, loaded once for all its tasks."""
    key = (hashlib.sha256(serialised.encode()).digest(), kind)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(serialised, kind)
    _encoders[key].memory = memory
    return _encoders[key]
