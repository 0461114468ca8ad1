"""BPE encoding and decoding (6): a deterministic automaton compiled from the merges.

The merge automaton reads token sequences and accepts those that BPE produces. It starts as
one state that loops on every base symbol. For each merge u v -> uv in order, a gadget is
added: where a u arc enters a state that has a v arc, the state is split; u arcs now enter a
copy without the v arc, and each state with a u arc gets a uv arc to where u v led. All arcs
with one label enter one state, so a state is named by a label and the number of its splits.
A copy is kept as a default arc to what it was copied from and the one label it lost, so the
table costs one entry a merge and not one per state and label; a transition follows default
arcs until an entry decides.

Words are symbols, not tokens, so a second table turns one into the other: the symbol
sequences of all labels are compiled into a deterministic matcher (transitions on symbols,
default arcs to the longest shorter suffix, and for each state the labels that end there,
longest first). A prefix of an accepted sequence is accepted, so each prefix of a word has one
accepted sequence, known by its last label. A word is encoded in one run from left to right:
each symbol is a transition of the matcher, and of the labels that end there the merge
automaton has an arc for exactly one, after the last label of the prefix that it leaves.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Chunks and words a worker remembers.
CACHE_CHUNKS = 500_000
CACHE_WORDS = 700_000

#: Stretches of these characters are normalised and split here; Unicode tables of libraries
#: differ on others, so those go through the normaliser and pre-tokenizer of the tokenizers library.
_PRINTED = re.compile(r"[\x21-\x7e]*")
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\u024f]*")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Automaton:
    """The merge automaton: transitions between labels (token ids) for one list of merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.size = size = max(vocabulary.values()) + 1
        self.born = [0] * size  # the merge that made a label; 0 for base symbols
        self.left = [0] * size  # its left part
        self.base: list[tuple[int, int] | None] = [None] * size  # the state its first arcs enter; None is the start
        self.splits: list[list[int]] = [[] for _ in range(size)]  # when its state was split
        self.gone: list[dict[int, int]] = [{} for _ in range(size)]  # label -> number of the split that removed its arc
        self.table: dict[int, bool] = {}
        products = {a + b for a, b in merges}
        self.live = {i for t, i in vocabulary.items() if t not in products}  # labels that occur
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(time, vocabulary[a], vocabulary[b], vocabulary[a + b])

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        if not {u, v} <= self.live or not self._has(u, len(self.splits[u]), v):
            return  # an earlier merge always comes first: this label is never made
        self.live.add(uv)
        self.born[uv], self.left[uv] = time, u
        self.base[uv] = (v, len(self.splits[v]))
        self.splits[u].append(time)
        self.gone[u][v] = len(self.splits[u])

    def _has(self, label: int, split: int, w: int) -> bool:
        """Whether the state that arcs of ``label`` entered after ``split`` splits has an arc w."""
        while True:
            born = self.born[w]
            if split and self.splits[label][split - 1] > born:
                if self.gone[label].get(w, split + 1) <= split:
                    return False
                split = bisect_right(self.splits[label], born, 0, split)
                continue
            if split == 0 and self.base[label] is not None and self.born[label] >= born:
                # the state is older than the label: go to whose state it was
                label, split = self.base[label]
                continue
            if born == 0:
                return True
            w = self.left[w]

    def allows(self, a: int, b: int) -> bool:
        """Whether the state that a enters has an arc b."""
        key = a * self.size + b
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._has(a, len(self.splits[a]), b)
        return known


class Matcher:
    """Tables over symbols: which labels end at each place of a word.

    ``step`` holds the transitions (state * symbols + symbol), ``default`` the state of the longest
    proper suffix, ``label`` and ``depth`` what a state spells (label -1: nothing), ``ends`` the
    nearest state on the default arcs, itself included, that spells a label, and ``next``
    the one after it.
    """

    def __init__(self, spelled: dict[int, tuple[str, ...]]):
        self.code = {c: i for i, c in enumerate(sorted({c for word in spelled.values() for c in word}))}
        self.symbols = len(self.code)
        self.step: dict[int, int] = {}
        self.label, self.depth = [-1], [0]
        for label, word in spelled.items():
            self.label[self._path(word)] = label
        self._defaults()

    def _path(self, word: tuple[str, ...]) -> int:
        state = 0
        for c in word:
            key = state * self.symbols + self.code[c]
            if key not in self.step:
                self.step[key] = len(self.label)
                self.label.append(-1)
                self.depth.append(self.depth[state] + 1)
            state = self.step[key]
        return state

    def _defaults(self) -> None:
        n = len(self.label)
        self.default, self.ends, self.next = [0] * n, [0] * n, [0] * n
        for key, state in sorted(self.step.items(), key=lambda x: self.depth[x[1]]):
            above, c = divmod(key, self.symbols)
            self.default[state] = to = self.read(self.default[above], c) if above else 0
            self.next[state] = self.ends[to]
            self.ends[state] = state if self.label[state] >= 0 else self.ends[to]

    def read(self, state: int, c: int) -> int:
        """The transition of ``state`` on symbol c, by default arcs where it has none of its own."""
        while (to := self.step.get(state * self.symbols + c)) is None and state:
            state = self.default[state]
        return to or 0


class WordEncoder:
    """Encodes words of base symbols with the two tables."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.automaton = Automaton(vocabulary, merges)
        self.suffix = suffix
        spelled = {t: (t,) for t in vocabulary if len(t) == 1 or suffix and len(t) == 1 + len(suffix) and t.endswith(suffix)}
        for a, b in merges:
            spelled[a + b] = spelled[a] + spelled[b]
        self.matcher = Matcher({vocabulary[t]: w for t, w in spelled.items() if vocabulary[t] in self.automaton.live})

    def __call__(self, word: str) -> list[int]:
        if not word:
            return []
        m, table, allows, size = self.matcher, self.automaton.table, self.automaton.allows, self.automaton.size
        label, depth, after = m.label, m.depth, m.next
        symbols = [*word[:-1], word[-1] + self.suffix]
        last, back, state = [-1], [0], 0
        for j, symbol in enumerate(symbols, 1):
            state = m.read(state, m.code[symbol])
            end = m.ends[state]
            while end:
                w, i = label[end], j - depth[end]
                if i == 0:
                    break
                known = table.get(last[i] * size + w) if last[i] >= 0 else False
                if known or known is None and allows(last[i], w):
                    break
                end = after[end]
            # A prefix that no label ends is inside a symbol's label only; the last one always ends.
            last.append(label[end] if end else -1)
            back.append(j - depth[end])
        out, n = [], len(symbols)
        while n:
            if last[n] < 0:
                raise ValueError(f"no label for {word!r}")
            out.append(last[n])
            n = back[n]
        return out[::-1]


class TextEncoder:
    """Whole texts as the tokenizers library encodes them with a JSON vocabulary of words with ends.

    The normaliser and the pre-tokenizer are read from the file; both act within stretches
    without white space, which repeat and are remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = WordEncoder(vocabulary, merges, model.get("end_of_word_suffix") or "")
        self.label = {i: t for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        rule = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # In plain stretches letters are what \w has besides digits and _, and numbers what is left of \p{N}.
        plain = rule["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", r"(?:_|[^\w\s²³¹¼½¾])").replace(r"[\p{L}]", r"[^\W\d_²³¹¼½¾]").replace(r"[\p{N}]", r"[\d²³¹¼½¾]")
        self.rule = re.compile(plain)
        self.tokenizer = Tokenizer.from_file(path)
        self.symbol = byte_symbols()
        self.table = str.maketrans({chr(b): s for b, s in self.symbol.items()})
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.words(word)
            if len(self.known) < CACHE_WORDS and len(word) < 64:
                self.known[word] = ids
        return ids

    def _ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.split_special.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if _PRINTED.fullmatch(part):
                words = self.rule.findall(part.lower())
            elif _PLAIN.fullmatch(part):
                words = [w.encode().decode("latin-1").translate(self.table) for w in self.rule.findall(unicodedata.normalize("NFC", part).lower())]
            else:
                words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
            for word in words:
                out += self.word(word)
        return out

    def chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        """ids as little-endian uint32 bytes, and the labels joined by spaces."""
        known = self.chunks.get(chunk)
        if known is None:
            ids = self._ids(chunk.decode())
            known = (np.array(ids, "<u4").tobytes(), " ".join([self.label[i] for i in ids]).encode())
            if len(self.chunks) < CACHE_CHUNKS and len(chunk) < 64:
                self.chunks[chunk] = known
        return known

    def __call__(self, text: bytes) -> tuple[bytes, bytes]:
        chunk = self.chunk
        parts = [chunk(c) for c in text.split()]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[1]])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids])


@cache
def text_encoder(path: str) -> TextEncoder:
    """One per worker process and vocabulary, kept across tasks; a bare name is a public vocabulary's."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return TextEncoder(path)


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                ids, decoded = encode(text or b"")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and digests of the ids and of the decoded text.

    vocabulary: path of the JSON file on the executors, or the name of a public one. Defined
    cases: a null text counts as empty and has no ids; null ids and repeated rows pass through;
    texts and words may be of any length; an empty table gives an empty table; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digest(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for batch in batches:
            pairs = [encode(t or b"") for t in batch["text"].cast(pa.binary()).to_pylist()]
            ids = [np.frombuffer(p[0], "<u4").astype(np.int32) for p in pairs]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, flat), pa.array([p[1].decode() for p in pairs])], ["doc_id", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int) and decoded (the arc labels, joined by spaces)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(vocabulary), "doc_id long, ids array<int>, decoded string")
