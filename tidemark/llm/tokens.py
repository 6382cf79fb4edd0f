"""Token ids of whole texts by a public tokenizer file, inside Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

#: Words whose ids a worker remembers; it forgets all of them when there are more.
REMEMBERED = 900_000
#: Stands between words that are encoded together; it can't be part of another token.
MARK = b"\x01"
#: Latin letters between ASCII marks other than the apostrophe: the letters are one token word, each run of marks another.
PLAIN = re.compile(rb"([!-&(-/:-@\[-`{-~]*)((?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Words of several kinds and white space, to see whether a tokenizer takes words one by one.
PROBES = ["word", "\u00c9a", "7", "'s", "...", "<|", "\u70ed", "\u00df", "\u0301x", "I'm", "a.b", "\U0001f4a1"]
GAPS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
LETTERS = [*map(chr, range(97, 123)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    Tokenizers that drop white space and never join characters across it, as word_bpe_49k does, get words (runs without
    ASCII white space), whose ids are remembered; a text's ids are those of its words one after the other. All others
    get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = self._takes_words(path)
        self.known: dict[bytes, bytes] = {}
        marks = self._ids(MARK.decode())
        self.mark = int(marks[0]) if len(marks) == 1 else None
        self.letters = self._byte_level()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _takes_words(self, path: str) -> bool:
        """Whether white space never matters between words of many kinds, nor before, after or in added tokens."""
        for token in json.loads(Path(path).read_text()).get("added_tokens") or []:
            if token.get("lstrip") or token.get("rstrip") or set(token["content"]) & set(" \t\n\r\x0b\x0c"):
                return False
        alone = {w: self._ids(w).tolist() for w in PROBES}
        ids = self.tokenizer.encode_batch([f"{gap}{a}{gap}{b}{gap}" for gap in GAPS for a in PROBES for b in PROBES], add_special_tokens=False)
        want = [alone[a] + alone[b] for _ in GAPS for a in PROBES for b in PROBES]
        return [x.ids for x in ids] == want and not any(len(self._ids(gap)) for gap in GAPS)

    def _byte_level(self) -> dict[int, str] | None:
        """How the model wants Latin letters, if it takes a lower-cased word as one piece; None if it doesn't."""
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {ord(c): split.pre_tokenize_str(c)[0][0] for c in LETTERS}
        for word in ("".join(LETTERS), "The", "W\u00d6RTER", "tional", "\u00c9t\u00e9", "a"):
            model = [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(table))]
            whole = self.tokenizer.encode(f"{word}.,({word}", add_special_tokens=False).ids
            marks = self.tokenizer.encode(".,(", add_special_tokens=False).ids
            if whole != model + marks + model:
                return None
        return table

    def _one(self, word: bytes) -> bytes:
        """A run of marks, or a word that is no plain one."""
        if word not in self.known:
            self.known[word] = self._ids(word.decode("utf-8", "replace")).tobytes()
        return self.known[word]

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        known, table, tokenize, packed, others = self.known, self.letters, self.tokenizer.model.tokenize, self.packed, []
        match = PLAIN.fullmatch
        for word in words:
            m = match(word) if table else None
            if m is None or b"<|" in word:
                others.append(word)
                continue
            head, core, tail = m.groups()
            if core.isascii():
                core = core.lower()
                raw = known.get(core)
                letters = core.decode() if raw is None else ""
            else:
                letters = core.decode().lower()
                core = letters.encode()
                raw = known.get(core)
                letters = letters.translate(table) if raw is None else ""
            if raw is None:
                raw = known[core] = b"".join([packed[t.id] for t in tokenize(letters)])
            if head:
                raw = (known.get(head) or self._one(head)) + raw
            if tail:
                raw += known.get(tail) or self._one(tail)
            known[word] = raw
        plain = [w for w in others if MARK not in w] if self.mark is not None else []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self._ids((b" " + MARK + b" ").join(some).decode("utf-8", "replace"))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, ends, strict=True):
                known[word] = raw[4 * start : 4 * end]
                start = end + 1
        for word in others:
            self._one(word)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_words:
            yield from (self._ids(text.decode("utf-8", "replace")).tobytes() for text in texts)
            return
        known = self.known
        for text in texts:
            words = text.split()
            try:
                yield b"".join([known[w] for w in words])
            except KeyError:
                new = list({w: None for w in words if w not in known})
                if len(self.known) + len(new) > REMEMBERED:
                    new = list(dict.fromkeys(words))
                self._learn(new)
                yield b"".join([known[w] for w in words])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
