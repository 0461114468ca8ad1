"""Byte-level BPE ids of whole texts, with a cache of pieces per worker."""

from __future__ import annotations

import base64
import ctypes
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa

END_ID = 0
#: Pieces a worker remembers; beyond that it encodes without remembering.
CACHE_PIECES = 600_000

#: A space that follows other white space, and the places where a text with one may be cut.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?= (?!\s|<\|))")
#: Pieces of these characters are the same words and classes for both libraries' tables.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*")
_SPECIAL = "<|endoftext|>"


class PieceEncoder:
    """Encodes texts as the tokenizers library does with the vocabulary ``name``; ids as little-endian uint16 bytes.

    The pre-tokenizer never joins a non-space with the white space after it, and of a run of
    white space it gives a last space to the word that follows. So a text may be cut before
    each space that a non-space follows (not before one that may begin a special string, as
    these are cut out first, and a run before them keeps its last space) and each piece
    encoded alone. Pieces repeat, so most are looked up. Of the others plain ones, of any
    length, go to tiktoken with the ranks of the same merges and the pattern of the same
    pre-tokenizer; those with other scripts or special strings go to the tokenizers library.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.library.no_padding()
        self.library.no_truncation()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{name} has more ids than 16 bits hold")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece) and _SPECIAL not in piece:
            ids = self.plain.encode_ordinary(piece)
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if _RUN.search(text):
            pieces = _CUT.split(text)
        else:
            pieces = text.split(" ")
            pieces[1:] = [" " + p for p in pieces[1:]]
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = self.piece(p)
                    if len(known) < CACHE_PIECES and len(p) < 64:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)


@cache
def encoder(name: str = "byte_bpe_50k") -> PieceEncoder:
    """One encoder per worker process, kept across its tasks until ``release``."""
    return PieceEncoder(name)


def release() -> None:
    """Gives back what this process holds for encoders, up to some 200 MB; the next one is built anew.

    Workers outlive operators, so those that need room call this before they take it.
    """
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim:
            trim(0)
