"""Token counts of a word-level byte-pair vocabulary, by merging without emitting tokens.

The vocabulary file (``tokenizers`` JSON) tells how texts are normalised and cut
into words; the words are merged here: the symbols of a word form a linked
list, a heap holds its adjacent pairs by rank, the lowest is popped and merged
until none is left.  A word has as many tokens as symbols at first, less the
merges; no token is named or listed.

A text needs no shuffle.  Words between white space are counted once per task
and kept in a bounded memory, as texts repeat them.

Defined cases: null and empty texts have 0 bytes and 0 tokens.  Repeated rows
and ids return once each; a null doc_id stays null.  Special strings inside a
text (``<|endoftext|>``) are one token each, as the library has it; none is added
at the ends, and texts of any length are counted whole.  Extra columns are left
out.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sievelight.llm.tokens import pieces

FILE = "word_bpe_49k.json"
LIMIT = 2048
#: Counts that a task keeps of each kind before older ones go, and the longest entry (bytes) among them.
KEPT, KEPT_BYTES = 200_000, 64
#: The cut of printable ASCII text after lower-casing, as the vocabulary file states it for all of Unicode.
ASCII_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(rb"[\x21-\x7e]+")


class Kept:
    """Counts of the latest entries: the newest half and the half before it."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, count: int) -> None:
        if len(key) <= KEPT_BYTES:
            if len(self.new) >= KEPT:
                self.old, self.new = self.new, {}
            self.new[key] = count


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


class PairMerger:
    """Counts tokens of texts under the vocabulary in ``path``.

    Words must be parted by white space that yields no tokens, and every byte
    must have a symbol; other vocabularies are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or odd or any(t["normalized"] or t["single_word"] or not t["special"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} holds no plain word-level byte-pair vocabulary")
        library = Tokenizer.from_file(path)
        self._clean, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if [w for w, _ in self._cut(self._clean("a \t\n\x0b\x0c\rb"))] != ["a", "b"]:
            raise ValueError(f"the words of {path} hold white space")
        self._suffix, self._symbols = model["end_of_word_suffix"], model["vocab"]
        self._merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._merges[self._symbols[left], self._symbols[right]] = (rank, self._symbols[left + right])
        self._names = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, self._names)) or r"(?!)")
        cuts = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        self._plain = cuts[:1] == [ASCII_PATTERN]
        self._chunks, self._words = Kept(), Kept()

    def word(self, letters: str) -> int:
        """Tokens of one word, given as byte letters."""
        found = self._words.get(letters)
        if found is None:
            found = self._merge(letters)
            self._words.put(letters, found)
        return found

    def _merge(self, letters: str) -> int:
        names = [*letters[:-1], letters[-1] + self._suffix]
        symbols = [self._symbols[s] for s in names]
        n, merges = len(symbols), self._merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            # A pair that is gone or has changed since it was pushed is left.
            if symbols[i] < 0 or j >= n or merges.get((symbols[i], symbols[j]), (0, -1))[1] != made:
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            merged += 1
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((made, symbols[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if before[i] >= 0 and (m := merges.get((symbols[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], m[1]))
        return n - merged

    def chunk(self, chunk: bytes) -> int:
        """Tokens of a stretch of text without white space."""
        found = self._chunks.get(chunk)
        if found is None:
            text = chunk.decode("utf-8", "replace")
            parts = self._special.split(text) if any(s in text for s in self._names) else [text]
            if self._plain and PRINTABLE.fullmatch(chunk):
                cut = [w for part in parts for w in ASCII_WORDS.findall(part.lower())]
            else:
                cut = [w for part in parts if part for w, _ in self._cut(self._clean(part))]
            found = len(parts) - 1
            for w in cut:
                found += self.word(w)
            self._chunks.put(chunk, found)
        return found

    def texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Tokens of each text."""
        words = [(t or b"").split() for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        counts = np.array([self.chunk(x) for x in coded.dictionary.to_pylist()], np.int64)
        per = counts[coded.indices.to_numpy(zero_copy_only=False)] if len(rows) else counts
        return np.bincount(rows, per, len(texts)).astype(np.int64)


@lru_cache(2)
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs(doc_id, text)``.

    ``path`` names a vocabulary file that all executors have; by default each
    takes the one of its installed package.
    """

    def run(batches):
        merger = _merger(path or default_path())
        for batch in pieces(batches, "text"):
            text = batch.column("text").cast(pa.binary())
            tokens = merger.texts(text.to_pylist())
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            columns = [batch.column("doc_id").cast(pa.int64()), n_bytes, pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
