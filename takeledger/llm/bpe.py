"""Exact BPE by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from takeledger.llm.common import as_texts
from takeledger.llm.tokencount import byte_letters

#: White-space-free chunks and words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 250_000
#: Compatible and incompatible pairs that a worker remembers.
REMEMBERED_PAIRS = 2_000_000
#: Bytes that count as white space for str.split but not for the vocabulary's pattern.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


class BacktrackingBpe:
    """Encoder and decoder for a BPE vocabulary file with an end-of-word suffix.

    The next token is always the longest vocabulary entry that matches at the position, found by
    an Aho-Corasick automaton; it stands if merging would keep it and the token before it apart
    (pair compatibility). Otherwise its next shorter prefix is tried, then the token before it is
    taken back. A position that failed once is never tried again, so time is linear.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters, self.end = byte_letters(), "\0"  # one character stands for the suffix
        self.byte_map = {b: c for b, c in enumerate(self.letters)}
        spelled = {t: t[: -len(suffix)] + self.end if t.endswith(suffix) and len(t) > len(suffix) else t for t in vocab}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        size = max(vocab.values()) + 1
        self.order = np.arange(size).tolist()  # symbols in the order in which merging makes them
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.join: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(pairs):
            made = vocab[a + b]
            self.join[vocab[a], vocab[b]] = size + rank
            if self.parts[made] is None:
                self.parts[made] = (vocab[a], vocab[b])
                self.order[made] = size + rank
        self.length = [0] * size
        self.shorter: list[int] = [-1] * size
        by_text = {s: vocab[t] for t, s in spelled.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in by_text.items():
            self.length[t] = len(s)
            self.automaton.add_word(s, (len(s), t))
        self.automaton.make_automaton()
        for s, t in by_text.items():
            self.shorter[t] = next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1)
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        raw = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.offsets = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in raw], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[str, bytes]] = {}

    # ---- encoding

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' symbols ends in exactly these two tokens."""
        pair = (left, right)
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits = {}
            known = self.fits[pair] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        """Undo the latest merge on either side of the seam, again and again.

        At each step the symbols that touch the seam would have merged if their pair comes before
        the merge that used one of them up; on equal terms the pair further left comes first.
        """
        order, parts, join = self.order, self.parts, self.join
        limit = 1 << 62
        while True:
            if join.get((a, b), limit) < limit:
                return False
            if parts[a] is None and parts[b] is None:
                return True
            if parts[b] is None or (parts[a] is not None and order[a] > order[b]):
                limit, a = order[a], parts[a][1]
            else:
                limit, b = order[b] + 1, parts[b][0]

    def encode_word(self, letters: str) -> list[int]:
        """Token ids of one pre-token, spelled in byte letters, with its end mark."""
        n = len(letters)
        longest, reach = [-1] * n, [0] * n
        for end, (size, token) in self.automaton.iter(letters):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        if reach[0] == n:
            return [longest[0]]
        usable = [True] * (n + 1)
        usable[n - 1] = False  # the end mark never stands alone
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = ids[-1] if ids else -1
            while token >= 0:
                end = at + self.length[token]
                if usable[end] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                at += self.length[token]
                token = longest[at] if at < n else -1
            elif ids:
                usable[at] = False
                token = ids.pop()
                at -= self.length[token]
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return ids

    def _ids(self, piece: str) -> list[int]:
        """Ids of text that is normalised already."""
        ids: list[int] = []
        for word in self.split.findall(piece):
            got = self.words.get(word)
            if got is None:
                got = self.encode_word(word.encode("utf-8", "replace").decode("latin-1").translate(self.byte_map) + self.end)
                if len(word) <= 64:
                    if len(self.words) >= REMEMBERED:
                        self.words = {}
                    self.words[word] = got
            ids += got
        return ids

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        got = self.chunks.get(chunk)
        if got is None:
            ids = self._ids(chunk)
            got = (" ".join(map(str, ids)), np.array(ids, dtype=np.int32).tobytes())
            if len(chunk) <= 64:
                if len(self.chunks) >= REMEMBERED:
                    self.chunks = {}
                self.chunks[chunk] = got
        return got

    def _piece(self, text: str) -> list[tuple[str, bytes]]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if _ODD_SPACE.search(text):
            ids = self._ids(text)
            return [(" ".join(map(str, ids)), np.array(ids, dtype=np.int32).tobytes())] if ids else []
        known, chunk = self.chunks, self._chunk
        return [known.get(c) or chunk(c) for c in text.split()]

    def encode(self, text: str | None) -> tuple[str, np.ndarray]:
        """Decimal ids joined by spaces, and the ids; null is the empty text.

        Added special strings in the text become their ids, as the library does by default.
        """
        parts: list[tuple[str, bytes]] = []
        for i, piece in enumerate(self.at_special.split(text) if text and self.at_special else [text or ""]):
            if i % 2:
                parts.append((str(self.special[piece]), np.array([self.special[piece]], dtype=np.int32).tobytes()))
            elif piece:
                parts += self._piece(piece)
        return " ".join([p[0] for p in parts]), np.frombuffer(b"".join([p[1] for p in parts]), dtype=np.int32)

    # ---- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' spellings joined by one space (the file names no decoder)."""
        if not len(ids):
            return b""
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = np.cumsum(size)
        where = np.repeat(begin - (total - size), size) + np.arange(total[-1])
        return self.blob[where].tobytes()[:-1]


_CODERS: dict[str, BacktrackingBpe] = {}


def coder(path: str) -> BacktrackingBpe:
    """One per worker process."""
    if path not in _CODERS:
        _CODERS[path] = BacktrackingBpe(path)
    return _CODERS[path]


#: What encode_decode can return of a text besides its number of tokens.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids_sha256", "decoded_sha256")) -> DataFrame:
    """(id, n_tokens, *outputs) of every row of docs: ids, the text decoded from them, or digests.

    Null and empty texts have no ids and decode to the empty text; repeated rows are each encoded;
    other columns are ignored; an empty table gives no rows. The result equals the vocabulary's
    merges exactly. There is no shuffle, and a worker holds an Arrow batch and REMEMBERED chunks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    decodes = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            n, columns = [], {o: [] for o in outputs}
            for t in as_texts(b["t"]):
                spelled, ids = c.encode(t)
                raw = c.decode(ids) if decodes else b""
                n.append(len(ids))
                for o, column in columns.items():
                    if o == "ids":
                        column.append(ids)
                    elif o == "decoded":
                        column.append(raw.decode())
                    else:
                        column.append(hashlib.sha256(raw if o == "decoded_sha256" else spelled.encode()).hexdigest())
            yield pd.DataFrame({id_col: b["k"], "n_tokens": n} | columns)

    picked = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    return picked.mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
