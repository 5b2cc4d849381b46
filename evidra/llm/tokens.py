"""Exact token ids through a cache of pre-tokens: each distinct pre-token is encoded by the tokenizer's own library."""

from __future__ import annotations

import json
import os
import re
import struct
from itertools import chain

#: The letters and numbers below U+0250, as in the Unicode classes L and N, and the white space
#: that the byte-level pre-tokenizer's pattern splits on. Texts with any other character go whole to the library.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t-\r "
PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Formats of few ids.
FORMS = [f"<{n}I" for n in range(32)]


def byte_chars() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as it is, the others as the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARS = byte_chars()
#: Characters whose class differs, or may differ, between libraries.
OTHER = re.compile(r"[^\t-\r -~\xa1-ɏ‐-‧‰-⁞₠-₿]")

#: Cached pre-tokens of one worker; beyond this the cache starts anew.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are not kept, so that the cache's size in bytes has a bound too.
LONGEST_KEPT = 64


class Encoder:
    """Encodes whole texts with the tokenizer file at path: .json through tokenizers, .model through sentencepiece.

    No begin, end or added special tokens; strings of special tokens inside a text get the library's default; nothing
    is truncated or padded. A byte-level file with the usual pattern goes by pre-token; any other goes by text."""

    def __init__(self, path: str) -> None:
        self.cache: dict[str, bytes] = {}
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ())
        )
        self.model = library.model
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or ()) or r"(?!)")

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None if the whole text has to go to the library."""
        if not self.by_piece or (not text.isascii() and OTHER.search(text)) or self.added.search(text):
            return None
        if text.isascii() and re.search("[\x00-\x08\x0e-\x1f\x7f]", text):
            return None
        return PIECES.findall(text)

    def look_up(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens from the library's model, which takes a pre-token's bytes as characters."""
        merge, found = self.model.tokenize, {}
        for p in new:
            ids = [t.id for t in merge((p if p.isascii() else p.encode().decode("latin-1")).translate(BYTE_CHARS))]
            found[p] = struct.pack(FORMS[len(ids)] if len(ids) < len(FORMS) else f"<{len(ids)}I", *ids)
        return found

    def learn(self, lists: list[list[str] | None]) -> dict[str, bytes]:
        """A look-up that has every pre-token of the lists: the cache, or a passing copy for those not kept."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = list(set(chain.from_iterable(x for x in lists if x)).difference(self.cache))
        if not new:
            return self.cache
        found = self.look_up(new)
        long = [p for p in new if len(p) > LONGEST_KEPT]
        extra = {p: found.pop(p) for p in long}
        self.cache.update(found)
        return _Both(self.cache, extra) if extra else self.cache

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        lists = [self.pieces(t) for t in texts]
        known = self.learn(lists)
        rest = [t for t, x in zip(texts, lists, strict=True) if x is None]
        whole = iter(self.whole(rest) if rest else ())
        return [b"".join(map(known.__getitem__, x)) if x is not None else struct.pack(f"<{len(ids := next(whole))}I", *ids) for x in lists]


class _Both(dict):
    """extra, and else what kept has."""

    def __init__(self, kept: dict[str, bytes], extra: dict[str, bytes]) -> None:
        super().__init__(extra)
        self.kept = kept

    def __missing__(self, piece: str) -> bytes:
        return self.kept[piece]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file; it stays, with its cache, for the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
